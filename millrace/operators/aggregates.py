"""Scans, projections, filters and aggregates, declared as queries over the adapter views."""

_RATE = "round(100.0 * sum(case when error <> '' then 1 else 0 end) / greatest(count(*), 1), 6) as error_rate"

SQL = {
    # scans and sinks
    "src_orm_scan": "select * from users",
    "src_keyed_lookup": "select endpoint, max_by(request_id, t * 100000.0 + request_id % 100000) as latest from request_metric where endpoint = '/click' group by endpoint",
    "src_pg_batch": "select 'users' as name, count(*) as n from users union all select 'api_keys', count(*) from api_keys",
    "src_load_gen": "select request_id, status, duration, status between 200 and 299 as success from request_metric",
    "src_psutil": "select id, process_memory_mb, system_percent from memory_stat",
    "src_inline_rows": "select severity, rank_ from severity",
    # projections and filters
    "prj_apikey": "select id, key, t, is_active from api_keys",
    "prj_role_content": "select conv_id, turn, role, text as content from chat",
    "prj_rename": "select schemaname, tablename, ins as inserts, upd as updates, del as deletes from table_stat",
    "prj_computed_sum": "select id, cast(ins + upd + del as bigint) as writes from table_stat",
    "prj_qualified_name": "select id, schemaname || '.' || tablename as qualified, split_part(schemaname || '.' || tablename, '.', -1) as tail from table_stat",
    "prj_truncate": "select conv_id, turn, left(text, 200) as head from chat",
    "flt_active_users": "select id, email from users where is_active",
    "flt_recent_active": "select u.id from users u join (select user_id, max(t) as last_seen from api_keys group by user_id) k on u.id = k.user_id where u.is_active and k.last_seen > 996624000.0 - 30 * 86400",
    "flt_owner": "select id, key from api_keys where user_id = 7",
    "flt_admin_filter": "select k.id, u.email from api_keys k join users u on k.user_id = u.id where k.is_active and lower(u.email) like '%00001%'",
    "flt_recent_hours": "select request_id from request_metric where t > $NOW - 48 * 3600",
    "flt_slow_query": "select id, query, time_ms from query_log where time_ms > 100 order by time_ms desc, id limit 50",
    "flt_slow_query_log": "select id, time_ms from query_log where time_ms * 1000 > 100000",
    "flt_slow_capture": "select request_id, duration from request_metric where duration > 100 order by t desc, request_id desc limit 100",
    "flt_seq_scan_tables": "select id, tablename, seq_scan, seq_tup_read from table_stat where seq_scan > 1000 and seq_tup_read > 100000",
    "flt_not_null_or": "select id from table_stat where last_analyze is null or last_autoanalyze is null",
    "flt_dead_ratio": "select id, round(1.0 * dead / greatest(live, 1), 6) as ratio from table_stat where 1.0 * dead / greatest(live, 1) > 0.1",
    "flt_index_usage": "select id, case when idx_scan = 0 then 'unused' else 'hot' end as kind from index_stat where idx_scan = 0 or idx_scan > 10000",
    "flt_success": "select request_id from request_metric where status >= 200 and status < 300",
    "flt_nonblank": "select conv_id, turn from chat where trim(text) <> ''",
    "flt_skip_paths": "select request_id from request_metric where not ($STARTS(endpoint, '/view') or $STARTS(endpoint, '/sign'))",
    "prd_header_missing": "select page_id, h.name as missing from pages cross join (values ('viewport'), ('charset'), ('robots')) as h(name) where html is null or position(h.name in html) = 0",
    # aggregates
    "agg_user_stats": "select u.id, u.email, count(r.id) as total_requests, max(r.t) as last_request, round(avg(r.response_time_ms), 6) as avg_response from users u left join api_requests r on u.id = r.user_id where u.is_active group by u.id, u.email",
    "agg_conn_by_state": "select coalesce(state, 'unknown') as state, count(*) as n, cast(sum(count(*)) over () as bigint) as total, round(100.0 * sum(count(*)) over () / 200, 6) as utilisation from pg_stat_activity group by coalesce(state, 'unknown')",
    "agg_db_summary": "select q.n as query_count, q.avg_time, q.slow, round(1.0 * q.n / greatest(r.n, 1), 6) as per_request from (select count(*) as n, round(avg(time_ms), 6) as avg_time, count(case when time_ms > 100 then 1 end) as slow from query_log) q cross join (select count(*) as n from request_metric) r",
    "agg_cache_counters": "select endpoint as op, count(*) as total, count(case when status = 200 then 1 end) as hits, count(case when status <> 200 then 1 end) as misses from request_metric group by endpoint",
    "agg_memory_summary": "select round(max_by(process_memory_mb, t * 100000.0 + id % 100000), 6) as current_mb, round(avg(process_memory_mb), 4) as avg_mb from memory_stat",
    "agg_perf_summary": f"select count(*) as total, round(avg(duration), 6) as avg_duration, round(avg(cpu_usage), 6) as avg_cpu, round(avg(memory_usage), 6) as avg_memory, count(nullif(error, '')) as errors, {_RATE} from request_metric where t > $NOW - 15 * 86400",
    "agg_endpoint_stats": f"select method || ' ' || endpoint as name, count(*) as n, round(sum(duration), 4) as total_duration, round(avg(duration), 6) as avg_duration, count(nullif(error, '')) as errors, {_RATE} from request_metric group by method || ' ' || endpoint",
    "agg_model_stats": "select model_name, count(*) as n, cast(sum(tokens_generated) as bigint) as tokens, round(avg(duration), 6) as avg_duration, round(case when sum(tokens_generated) > 0 then sum(tokens_generated) / sum(duration) else 0 end, 6) as tokens_per_second from request_metric where model_name is not null group by model_name",
    "agg_model_summary": f"select model_name, count(*) as n, round(avg(duration), 6) as avg_time, round(avg($PER(tokens_generated, duration)), 6) as avg_tps, round(avg(memory_usage), 6) as avg_peak, cast(sum(tokens_generated) as bigint) as tokens, {_RATE} from request_metric group by model_name",
    "agg_batch_perf": "select batch_size, count(*) as n, round(sum(duration), 4) as total_time, cast(sum(tokens_generated) as bigint) as tokens, round(avg(duration), 6) as avg_time from request_metric group by batch_size",
    "agg_gpu_metrics": "select round(avg(gpu_percent), 6) as avg_gpu, round(max(gpu_percent), 6) as max_gpu, round(avg(nullif(gpu_percent, 0)), 6) as avg_used from memory_stat",
    "agg_compare_models": """with m as (select model_name, avg(duration) as a, avg($PER(tokens_generated, duration)) as tps, avg(memory_usage) as mem, avg(case when error <> '' then 1.0 else 0.0 end) as err from request_metric group by model_name)
        select $MIN_BY(model_name, a) as fastest, $MAX_BY(model_name, tps) as best_tps, $MIN_BY(model_name, mem) as leanest, $MIN_BY(model_name, err) as safest from m""",
    "agg_best_batch": "with b as (select batch_size, avg($PER(tokens_generated, duration)) as tps from request_metric group by batch_size) select $MAX_BY(batch_size, tps) as best from b having count(*) > 1",
    "agg_profile_latest": "with l as (select endpoint, duration, row_number() over (partition by endpoint order by t desc, request_id desc) as n from request_metric) select count(*) as views, round(sum(duration), 6) as total, round(avg(duration), 6) as avg_time, max_by(endpoint, duration) as slowest from l where n = 1",
    "agg_mem_trends": "select round(min(process_memory_mb), 6) as lo, round(max(process_memory_mb), 6) as hi, case when max_by(process_memory_mb, t * 100000.0 + id % 100000) > min_by(process_memory_mb, t * 100000.0 + id % 100000) then 'increasing' else 'decreasing' end as trend, min(python_objects) as objects_lo, max(python_objects) as objects_hi, count(gpu_percent) as gpu_n from memory_stat",
    "agg_pg_statements": "select query, count(*) as calls, round(sum(time_ms), 4) as total_time, round(avg(time_ms), 6) as mean_time, round(min(time_ms), 6) as min_time, round(max(time_ms), 6) as max_time, round(stddev_pop(time_ms), 6) as stddev_time, cast(sum(rows_) as bigint) as rows_ from query_log group by query",
    "agg_table_stats": "select count(*) as total, count(case when 1.0 * dead / greatest(live, 1) > 0.1 then 1 end) as need_vacuum, count(case when last_analyze is null or last_autoanalyze is null then 1 end) as need_analyze from table_stat",
    "agg_locust_totals": "select count(*) as requests, count(nullif(error, '')) as failures, round(100.0 * count(nullif(error, '')) / greatest(count(*), 1), 6) as failure_pct, round(avg(duration), 6) as avg_time, round(max(duration), 6) as max_time from request_metric",
    "agg_cache_hit_rate": "select round(100.0 * count(case when status = 200 then 1 end) / greatest(count(*), 1), 6) as hit_rate from request_metric",
    "agg_status_hist": "select status, count(*) as n from request_metric group by status",
    "agg_uptime": "with p as (select floor(t / 300) as period, avg(case when status = 200 then 1.0 else 0.0 end) as healthy from request_metric group by floor(t / 300)) select round(100.0 * count(case when healthy >= 1 then 1 end) / greatest(count(*), 1), 6) as uptime from p",
    "agg_monthly_requests": "select count(*) as n, round(sum(value), 4) as total from metric_point where t >= 1704067200",
    "agg_avg_latency": "with p as (select avg(duration) as a from request_metric group by floor(t / 300)) select round(avg(a) * 1000, 4) as latency_ms from p",
    "agg_cw_latest": "with p as (select floor(t / 300) as period, avg(value) as a, max(value) as m, sum(value) as s from metric_point group by floor(t / 300)) select round(max_by(a, period) * 1000, 4) as latest_avg, round(max_by(m, period) * 1000, 4) as latest_max, round(sum(s), 4) as total, round(sum(s) / (24 * 3600), 6) as per_second from p",
    "agg_http_class": "select cast(floor(t / 300) as bigint) * 300 as period, cast(floor(status / 100) as bigint) as class, count(*) as n from request_metric group by cast(floor(t / 300) as bigint), cast(floor(status / 100) as bigint)",
    "agg_severity_counts": "select count(case when duration > 400 then 1 end) as critical, count(case when duration > 300 and duration <= 400 then 1 end) as high, count(case when duration > 300 then 1 end) as blocking from request_metric",
    "agg_usage_billing": "select user_id, model_name, cast(sum(tokens_generated) as bigint) as tokens from request_metric group by user_id, model_name",
}
