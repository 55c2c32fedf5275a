"""Joins, ordered analytics, top-k, set operations and rules."""

_LAST = "t * 100000.0 + request_id % 100000"

SQL = {
    "join_left_user_stats": "select u.id, r.id as request_id from users u left join api_requests r on u.id = r.user_id",
    "join_inner_3way_locks": "select c.relname, l.mode, l.granted, a.query, l.query_start, l.l_orderkey, l.l_linenumber from pg_locks l join pg_class c on l.relation = c.oid join pg_stat_activity a on l.pid = a.pid where not l.granted",
    "join_fk_select_related": "select k.id, u.email from api_keys k join users u on k.user_id = u.id",
    "join_one_to_one": "select a.id, b.role from users a join users b on a.id = b.id",
    "join_admin_search": "select k.id from api_keys k join users u on u.id = k.user_id where lower(u.email) like '%42%'",
    "join_enum_dim": "select s.severity, coalesce(f.n, 0) as n from severity s left join (select case when duration > 400 then 'critical' when duration > 300 then 'high' else 'low' end as severity, count(*) as n from request_metric group by case when duration > 400 then 'critical' when duration > 300 then 'high' else 'low' end) f on s.severity = f.severity",
    "join_cross_cases": "select e.endpoint, p.payload from (select distinct endpoint from request_metric) e cross join (values ('a'), ('b'), ('c')) as p(payload)",
    "join_zip_pos": "select a.conv_id, a.n, a.text as prompt, b.text as reply from (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from chat where role = 'user') a join (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from chat where role = 'assistant') b on a.conv_id = b.conv_id and a.n = b.n",
    "join_model_names": "select model_name, count(*) as n from request_metric where model_name in ('model_0', 'model_2') group by model_name",
    "join_multi_report": "select a.n as requests, b.n as queries, c.n as samples from (select count(*) as n from request_metric) a cross join (select count(*) as n from query_log) b cross join (select count(*) as n from memory_stat) c",
    # ordered analytics
    "win_running_avg": "select request_id, round(avg(duration) over (partition by user_id order by t, request_id rows between unbounded preceding and current row), 9) as running from request_metric",
    "win_running_peak": "select request_id, max(duration) over (partition by user_id order by t, request_id rows between unbounded preceding and current row) as peak from request_metric",
    "win_stream_count": "select conv_id, turn, row_number() over (partition by conv_id order by turn) as chunk from chat",
    "win_last_errors": "select endpoint, request_id from request_metric where error <> '' order by t desc, request_id desc limit 10",
    "win_last_snapshots": "select id, process_memory_mb from memory_stat order by t desc, id desc limit 10",
    "win_history_trim": "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as n, count(*) over (partition by conv_id) as c from chat) x where c <= 10 or n <= 6",
    "win_first_last_diff": f"select user_id, round(max_by(duration, {_LAST}) - min_by(duration, {_LAST}), 6) as growth, max_by(duration, {_LAST}) > min_by(duration, {_LAST}) as rising from request_metric group by user_id",
    "win_snapshot_diff": "select coalesce(a.site, b.site) as site, coalesce(b.size_, 0) - coalesce(a.size_, 0) as diff from (select endpoint as site, count(*) as size_ from request_metric where t < 1705276800 and status = 200 group by endpoint) a full outer join (select endpoint as site, count(*) as size_ from request_metric where t >= 1705276800 group by endpoint) b on a.site = b.site order by abs(coalesce(b.size_, 0) - coalesce(a.size_, 0)) desc, site limit 10",
    "win_alarm_2of2": "with p as (select metric, cast(floor(t / 3600) as bigint) as period, avg(value) > 55 as breach from metric_point group by metric, cast(floor(t / 3600) as bigint)), w as (select metric, period, breach, lag(breach) over (partition by metric order by period) as before, lag(period) over (partition by metric order by period) as prior from p) select metric, period * 3600 as period, breach and before and prior = period - 1 as alarm from w where prior is not null",
    # order and top-k
    "top_slow_50": "select query, mean_time from (select id as query, time_ms as mean_time from query_log) x order by mean_time desc, query limit 50",
    "top_tables_20": "select id, live from table_stat order by live desc, id limit 20",
    "top_hot_indexes_10": "select id, idx_scan from index_stat where idx_scan > 10000 order by idx_scan desc, id limit 10",
    "top_alloc_10": "select request_id, tokens_generated from request_metric order by tokens_generated desc, request_id limit 10",
    "top_profile_fns": "select endpoint, round(sum(duration), 4) as cumulative from request_metric group by endpoint order by 2 desc, 1 limit 20",
    "top_1": "select request_id as slowest, duration from request_metric order by duration desc, request_id limit 1",
    "srt_severity": "select severity, row_number() over (order by rank_ desc, severity) as place from severity",
    "srt_latest_backup": "select max('backup-' || cast(cast(floor(t / 86400) as bigint) as string)) as latest from query_log",
    "top_recent_events": "select event_id, t from (select event_id, t from metric_point order by t desc, event_id desc limit 10) x",
    # sets
    "set_union_all_findings": "select 'slow' as finding, request_id from request_metric where duration > 450 union all select 'error', request_id from request_metric where error <> ''",
    "set_union_all_rules": "select 'cpu' as rule, count(*) as n from request_metric where cpu_usage > 80 union all select 'memory', count(*) from request_metric where memory_usage > 85",
    "set_except": "select h.name from (values ('click'), ('view'), ('logout')) as h(name) where not exists (select 1 from metric_point m where m.metric = h.name)",
    # rules
    "rul_memory_recs": "select 'memory' as kind, count(*) as n from memory_stat where process_memory_mb > 8000 union all select 'objects', count(*) from memory_stat where python_objects > 1000000 union all select 'gpu', count(*) from memory_stat where gpu_percent > 85",
    "rul_auto_actions": "select id, case when process_memory_mb > 8000 then 'force_cleanup' when python_objects > 1000000 then 'collect' when gpu_percent > 85 then 'clear_cache' else 'none' end as action from memory_stat",
    "rul_memory_warn": "select id, case when process_memory_mb > 4000 then 'process' when system_percent > 85 then 'system' else 'gpu' end as warning from memory_stat where process_memory_mb > 4000 or system_percent > 85 or gpu_percent > 90",
    "rul_index_suggest": "select id, 'CREATE INDEX CONCURRENTLY idx_' || replace(tablename, ' ', '_') || ' ON ' || schemaname || '.' || replace(tablename, ' ', '_') as ddl from table_stat where seq_scan > 1000 and seq_tup_read > 100000",
    "rul_overall_status": "with a as (select endpoint, 100.0 * avg(case when status = 200 then 1.0 else 0.0 end) as ok, avg(duration) as mean from request_metric group by endpoint) select endpoint, case when ok < 95 then 'CRITICAL' when ok < 99.5 or mean >= 100 then 'NEEDS ATTENTION' else 'EXCELLENT' end as status from a",
    "rul_latency_sla": "select request_id, case when status <> 200 then 'error' when duration > 100 then 'slow' else 'ok' end as verdict from request_metric",
    "st_tumbling": "select cast(floor(t / 3600) as bigint) * 3600 as period, count(*) as n, round(avg(value), 6) as average from metric_point group by cast(floor(t / 3600) as bigint)",
    "st_xray_sampling": "select request_id from (select request_id, row_number() over (partition by floor(t) order by request_id) as n from request_metric) x where n = 1 or request_id % 100 < 5",
}
