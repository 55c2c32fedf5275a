"""Scalar functions, chat records and nested values."""

SQL = {
    "fn_token_count": "select conv_id, turn, cast($WORDS(text) as bigint) as tokens from chat",
    "fn_tokenize": "select conv_id, turn, $JOIN($TOKENS(text), ',') as head from chat",
    "fn_prompt_join": "select conv_id, md5($PROMPT) as prompt from chat group by conv_id",
    "fn_last_message": "select conv_id, max_by(text, turn) as last from chat group by conv_id",
    "fn_md5_prefix": "select conv_id, turn, left(md5(text), 8) as digest from chat",
    "fn_email_normalise": "select id, left(m, length(m) - length(split_part(m, '@', -1))) || lower(split_part(m, '@', -1)) as email from (select id, email || '@Example.COM' as m from users) x",
    "fn_upper_contains": "select page_id, upper(html) like '%COOKIE%' or upper(html) like '%TRACK%' as hit from pages",
    "fn_regex_ci": "select doc_id, case when $REGEX(lower(text), 'sql syntax|ora-[0-9]+') then 'sql' when $REGEX(lower(text), 'traceback|license') then 'debug' else 'none' end as kind from documents",
    "fn_basename_strip": "select id, replace(split_part('/backups/backup-' || key, '/', -1), 'backup-', '') as base from api_keys",
    "fn_bytes_to_mb": "select id, round(python_objects / 1048576.0, 9) as mb from memory_stat",
    "fn_ms": "select request_id, round(duration * 1000, 4) as ms from request_metric",
    "fn_safe_ratio": "select endpoint, round(100.0 * count(error) / greatest(count(*), 1), 6) as pct from request_metric group by endpoint",
    "fn_tokens_per_sec": "select request_id, round(case when duration > 0 then tokens_generated / duration else 0 end, 6) as tps from request_metric",
    "fn_default_falsy": "select request_id, coalesce(nullif(tokens_generated, 0), 100) as max_tokens, coalesce(nullif(error, ''), 'none') as error from request_metric",
    "fn_greatest": "select request_id, greatest(cpu_usage, memory_usage) as peak from request_metric",
    "fn_days_until": "select id, cast(floor((996624000.0 - t) / 86400) as bigint) as days from api_keys",
    "fn_epoch": "select event_id, cast(floor(t) as bigint) as created from metric_point",
    "fn_json_path": "select event_id, cast($JSON(props, '$.k') as bigint) as k from events",
    "fn_dict_get_default": "select event_id, coalesce($JSON(props, '$.absent'), 'none') as v from events",
    "fn_weighted_mix": "select metric, round(1.0 * count(*) / sum(count(*)) over (), 6) as share from metric_point group by metric",
    "fn_stage_ramp": "select s.t0 + i.i as second, round(s.v0 + (s.v1 - s.v0) * i.i / 10.0, 6) as users from (values (0, 0, 10), (10, 10, 10), (20, 10, 50)) as s(t0, v0, v1) cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) as i(i)",
}
