"""Adapter views: the driver's tables read as telemetry, catalog, chat and vector inputs.

Each view is one projection. ``$...`` marks the few words in which Spark SQL and the checking engine's SQL differ; all times are
epoch seconds, so results don't depend on a session time zone or on how a reader types timestamps. ``$PER`` divides doubles as
the checking engine does: by zero into an infinity, or NaN. ``$MAX_BY`` and ``$MIN_BY`` take the least of tied names, which SQL leaves open.
"""

from __future__ import annotations

import re

DIALECTS = {
    "spark": {
        "$EPOCH": r"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(\1 as timestamp_ntz)) / 1000000.0D)", "$K": "cast(get_json_object(props, '$.k') as int)",
        "$WORDS": r"regexp_count(\1, '\\\\S+')", "$TOKENS": r"filter(split(\1, '\\\\s+'), x -> x <> '')", "$STARTS": "startswith", 
        "$REGEX": r"(\1 rlike '\2')", "$JSON": "get_json_object", "$SHA_FROM": "sha2(", "$SHA_TO": ", 256)", "$JOIN": "array_join", "$PROMPT": "array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), chr(10))", "$NOW": "1706659200D",
        "$PER": r"case when \2 = 0 then \1 * case when startswith(cast(\2 as string), '-') then double('-Infinity') else double('Infinity') end else \1 / \2 end",
        "$MAX_BY": r"min_by(\1, case when \1 is not null and \2 is not null then struct(not isnan(\2), - \2, \1) end)", "$MIN_BY": r"min_by(\1, case when \1 is not null and \2 is not null then struct(\2, \1) end)",
    },
    "duck": {
        "$EPOCH": r"epoch(\1)", "$K": "cast(json_extract_string(props, '$.k') as integer)", "$WORDS": r"len(regexp_extract_all(\1, '\\S+'))", "$TOKENS": r"list_filter(regexp_split_to_array(\1, '\\s+'), lambda x: x <> '')",
        "$STARTS": "starts_with", "$REGEX": r"regexp_matches(\1, '\2')", "$JSON": "json_extract_string", "$SHA_FROM": "sha256(", "$SHA_TO": ")", "$JOIN": "array_to_string", "$PROMPT": "string_agg(text, chr(10) order by turn)", "$NOW": "1706659200::double",
        "$PER": r"\1 / \2", "$MAX_BY": r"max_by(\1, \2)", "$MIN_BY": r"min_by(\1, \2)",
    },
}

VIEWS = {
    "request_metric": """select event_id as request_id, '/' || event_type as endpoint, 'POST' as method, value as duration, cast($K as double) as cpu_usage,
        cast(($K * 7) % 100 as double) as memory_usage, $K as tokens_generated, 'model_' || cast(user_id % 3 as string) as model_name, 1 + event_id % 4 as batch_size,
        case when event_type = 'error' then 500 else 200 end as status, case when event_type = 'error' then 'boom' end as error, user_id, $EPOCH(ts) as t from events""",
    "users": "select c_custkey as id, c_name as email, c_acctbal > 0 as is_active, c_nationkey as group_id, c_mktsegment as role, c_custkey % 4 = 0 as verified, 946684800.0 + c_custkey * 86400 as joined from customer",
    "api_requests": "select o_orderkey as id, o_custkey as user_id, o_totalprice as response_time_ms, $EPOCH(o_orderdate) as t from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'",
    "api_keys": "select o_orderkey as id, o_custkey as user_id, o_orderstatus = 'O' as is_active, 'key-' || cast(o_orderkey as string) as key, $EPOCH(o_orderdate) as t from orders",
    "query_log": "select o_orderkey as id, o_orderpriority || ' ' || o_orderstatus as query, o_totalprice / 1000 as time_ms, 1 as rows_, $EPOCH(o_orderdate) as t from orders",
    "pg_locks": "select l_partkey as relation, l_suppkey as pid, l_returnflag <> 'R' as granted, l_linestatus as mode, l_orderkey, l_linenumber, $EPOCH(l_shipdate) as query_start from lineitem",
    "pg_class": "select p_partkey as oid, p_name as relname from part",
    "pg_stat_activity": "select s_suppkey as pid, s_name as query, case when s_nationkey % 3 = 0 then null when s_nationkey % 3 = 1 then 'idle' else 'active' end as state from supplier",
    "table_stat": """select p_partkey as id, p_brand as schemaname, p_type as tablename, cast(p_size as bigint) as live, cast(floor(p_retailprice) as bigint) % 50 as dead,
        case when p_partkey % 7 = 0 then null else p_partkey end as last_analyze, case when p_partkey % 11 = 0 then null else p_partkey end as last_autoanalyze,
        cast(floor(p_retailprice) as bigint) * 3 as seq_scan, cast(floor(p_retailprice) as bigint) * 200 as seq_tup_read, p_partkey % 5 as ins, p_partkey % 3 as upd, p_partkey % 2 as del from part""",
    "index_stat": "select p_partkey as id, p_brand as schemaname, p_type as tablename, p_name || '_idx' as indexname, case when p_partkey % 10 = 0 then 0 else cast(floor(p_retailprice * 15) as bigint) end as idx_scan from part",
    "metric_point": "select event_type as metric, value, $EPOCH(ts) as t, event_id from events",
    "chat": "select conv_id, turn, role, text from conversations",
    "memory_stat": "select event_id as id, value * 20 as process_memory_mb, cast($K as double) as system_percent, case when event_type = 'view' then cast($K as double) end as gpu_percent, event_id * 37 % 2000000 as python_objects, $EPOCH(ts) as t from events",
    "order_query": "select l_orderkey as request_id, l_linenumber as n, l_extendedprice / 1000 as time_ms from lineitem",
    "probe": """select event_id, '/' || event_type as endpoint, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then 'test' else 'tok-' || cast(event_id as string) end as token,
        case when event_id % 5 = 0 then 401 else 200 end as status from events""",
    "web_response": "select page_id, url, regexp_extract(url, '://[^/]*([^?#]*)', 1) as path, html as body, case when page_id % 7 = 0 then 404 else 200 end as status, length(html) as size from pages",
    "login": "select c_custkey as id, case when c_custkey % 5 = 0 then 'admin' else c_name end as name, case when c_custkey % 3 = 0 then 'admin' else 'pw' || cast(c_custkey as string) end as password, case when c_acctbal > 0 then 200 else 401 end as status from customer",
    "certificate": "select page_id, case when page_id % 6 = 0 then replace(url, 'https://', 'http://') else url end as url, 1706659200.0 + page_id % 90 * 86400 as expires, case when page_id % 11 = 0 then 'ECDHE-des-cbc3' else 'TLS_AES_128' end as cipher from pages",
    "service": """select n_name as service, count(*) as desired, count(case when s_acctbal > 0 then 1 end) as ready, count(*) as running, avg(s_suppkey % 100) as cpu, avg(s_suppkey * 7 % 100) as memory
        from supplier join nation on s_nationkey = n_nationkey group by n_name""",
    "setting": "select * from (values ('max_connections', '200'), ('work_mem', '64')) as s(name, setting)",
    "span": """select event_id as request_id, value / 10 as started, value / 10 + event_id % 17 as ended, cast($K as double) as cpu_start, cast(($K * 3) % 100 as double) as cpu_end from events""",
    "severity": "select * from (values ('critical', 4), ('high', 3), ('medium', 2), ('low', 1), ('info', 0)) as s(severity, rank_)",
}


def render(sql: str, dialect: str) -> str:
    for word, put in DIALECTS[dialect].items():
        if word in ("$EPOCH", "$WORDS", "$TOKENS"):
            sql = re.sub(re.escape(word) + r"\(([^()]*)\)", lambda m, p=put: p.replace("\\\\", "\\").replace(r"\1", m[1]), sql)
        elif word in ("$PER", "$MAX_BY", "$MIN_BY"):  # of two columns
            sql = re.sub(re.escape(word) + r"\((\w+), (\w+)\)", put, sql)
        elif word == "$REGEX":
            sql = re.sub(r"\$REGEX\(([^,()]*(?:\([^()]*\))?), '((?:[^'])*)'\)", lambda m, p=put, d=dialect: p.replace(r"\1", m[1]).replace(r"\2", m[2].replace("\\", "\\\\") if d == "spark" else m[2]), sql)
        else:
            sql = sql.replace(word, put)
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)  # doubles in either engine, never decimals


def used(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"(?:from|join|,)\s+{n}\b", sql, re.I)]
