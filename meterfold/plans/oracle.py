"""The derived views in plain SQL, and the query registry."""

import re

VIEWS = {
    "placed": """
SELECT s.s_suppkey, r.r_name AS region_name, s.s_name AS macrozone_name, s.s_acctbal
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "macrozones": """
SELECT region_name, macrozone_name AS name, lon0, lat0, lon0 + 0.01e0 AS lon, lat0 + 0.01e0 AS lat,
       CASE WHEN s_acctbal >= 5000 THEN 'indoor' ELSE 'outdoor' END AS type,
       TIMESTAMP '2024-01-01 00:00:00' AS creation_time, s_acctbal
FROM (SELECT *, -175e0 + cast(s_suppkey % 25 + 25 * ((s_suppkey // 2500) % 28) AS double) * 0.5e0 AS lon0,
             30e0 + cast((s_suppkey // 25) % 100 AS double) * 0.4e0
                  - cast((s_suppkey // 70000) % 3 AS double) * 40e0 AS lat0
      FROM placed)""",
    "zones": """
SELECT region_name, macrozone_name, 'zone-' || z.k AS name, TIMESTAMP '2024-01-01 00:00:00' AS creation_time
FROM placed CROSS JOIN (VALUES ('0'), ('1'), ('2')) z(k) WHERE s_acctbal >= 0""",
    "ev": "SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events",
    "located": """
SELECT p.region_name, p.macrozone_name, 'zone-' || cast(e.user_id % 3 AS varchar) AS zone_name,
       cast(e.user_id % 5 AS varchar) AS sensor_id, e.ts AS time, e.event_type AS type, e.value, e.event_id, e.k
FROM ev e JOIN placed p ON p.s_suppkey = (e.user_id // 15) * 10""",
    "readings": "SELECT * EXCLUDE (k) FROM located",
    "outbox": "SELECT * EXCLUDE (k), CASE WHEN k < 25 THEN 'pending' ELSE 'sent' END AS status FROM located",
    "macro_stats": """
SELECT l.l_shipdate AS time, p.region_name, p.macrozone_name, l.l_returnflag AS type,
       min(l.l_extendedprice) AS min_value, max(l.l_extendedprice) AS max_value,
       cast(sum(cast(l.l_extendedprice AS decimal(18,2))) AS double) / count(*) AS avg_value,
       cast(sum(cast(l.l_extendedprice AS decimal(18,2))) AS double) AS avg_sum, count(*) AS avg_count
FROM lineitem l JOIN placed p ON p.s_suppkey = l.l_suppkey GROUP BY ALL""",
    "heartbeats": """
SELECT CASE WHEN k <> 0 THEN time END AS time, CASE WHEN k = 2 THEN '' ELSE macrozone_name END AS macrozone,
       CASE WHEN k >= 50 THEN '' ELSE zone_name END AS zone,
       CASE WHEN k = 1 THEN '' ELSE 'hub-' || zone_name END AS hub_id
FROM located WHERE type = 'view'""",
    "configs": """
SELECT CASE type WHEN 'signup' THEN 'new_sensor' WHEN 'purchase' THEN 'new_edge'
                 WHEN 'click' THEN 'new_proximity' ELSE 'bogus' END AS msg_type,
       CASE WHEN k < 50 THEN 'edge_hub' ELSE 'edge_hub_filter' END AS service, time, region_name, macrozone_name,
       zone_name, 'hub-' || zone_name AS hub_id, sensor_id,
       CASE WHEN k < 50 THEN 'temperature' ELSE 'humidity' END AS sensor_type,
       'ref-' || cast(k AS varchar) AS sensor_reference
FROM located WHERE type <> 'view'""",
    "macrozone_hubs": """
SELECT hub_id AS id, region_name, macrozone_name, arg_min(service, (time, service)) AS service,
       min(time) AS registration_time, max(time) AS last_seen
FROM configs WHERE msg_type = 'new_proximity' AND time < TIMESTAMP '2024-01-16' GROUP BY ALL""",
    "zone_hubs": """
SELECT hub_id AS id, region_name, macrozone_name, zone_name, arg_min(service, (time, service)) AS service,
       min(time) AS registration_time, max(time) AS last_seen
FROM configs WHERE msg_type = 'new_edge' AND time < TIMESTAMP '2024-01-16' GROUP BY ALL""",
    "device_sensors": """
SELECT sensor_id AS id, region_name, macrozone_name, zone_name,
       arg_min(sensor_type, (time, sensor_type, sensor_reference)) AS type,
       arg_min(sensor_reference, (time, sensor_type, sensor_reference)) AS reference,
       min(time) AS registration_time, max(time) AS last_seen
FROM configs WHERE msg_type = 'new_sensor' AND time < TIMESTAMP '2024-01-16' GROUP BY ALL""",
    "region_hubs": """
SELECT region_name, 'rh-' || type AS id, min(type) AS service, min(time) AS registration_time, max(time) AS last_seen
FROM located GROUP BY region_name, 'rh-' || type""",
    "sensors": """
SELECT sensor_id AS id, region_name, macrozone_name, zone_name, min(time) AS registration_time,
       CASE WHEN count(*) > 1 THEN max(time) END AS last_seen
FROM located WHERE type = 'signup' AND time < TIMESTAMP '2024-01-03' GROUP BY ALL""",
    "received": "SELECT * FROM located WHERE k >= 15",
    "zone_q": """
SELECT time_bucket(INTERVAL '15 minutes', time) + INTERVAL '15 minutes' AS time, region_name, macrozone_name,
       zone_name, type, min(value) AS min_value, max(value) AS max_value,
       cast(sum(cast(value AS decimal(18,2))) AS double) / count(*) AS avg_value,
       cast(sum(cast(value AS decimal(18,2))) AS double) AS avg_sum, count(*) AS avg_count
FROM readings GROUP BY ALL""",
    "macro_q": """
SELECT time, region_name, macrozone_name, type, min(min_value) AS min_value, max(max_value) AS max_value,
       cast(sum(cast(avg_sum AS decimal(18,2))) AS double) / sum(avg_count) AS avg_value,
       cast(sum(cast(avg_sum AS decimal(18,2))) AS double) AS avg_sum, cast(sum(avg_count) AS bigint) AS avg_count
FROM zone_q GROUP BY ALL""",
    "region_q": """
SELECT time_bucket(INTERVAL '30 minutes', time) + INTERVAL '30 minutes' AS time, region_name, type,
       min(min_value) AS min_value, max(max_value) AS max_value,
       cast(sum(cast(avg_sum AS decimal(18,2))) AS double) / sum(avg_count) AS avg_value,
       cast(sum(cast(avg_sum AS decimal(18,2))) AS double) AS avg_sum, cast(sum(avg_count) AS bigint) AS avg_count
FROM macro_q GROUP BY ALL""",
    "macro_daily": """
SELECT date_trunc('day', time) AS day, region_name, macrozone_name, type, min(min_value) AS min_value,
       max(max_value) AS max_value,
       cast(sum(cast(avg_sum AS decimal(18,2))) AS double) / sum(avg_count) AS avg_value,
       cast(sum(cast(avg_sum AS decimal(18,2))) AS double) AS total_sum, cast(sum(avg_count) AS bigint) AS total_count
FROM macro_stats GROUP BY ALL""",
    "region_daily": """
SELECT day, region_name, type, min(min_value) AS min_value, max(max_value) AS max_value,
       cast(sum(cast(total_sum AS decimal(18,2))) AS double) / sum(total_count) AS avg_value,
       cast(sum(cast(total_sum AS decimal(18,2))) AS double) AS total_sum, cast(sum(total_count) AS bigint) AS total_count
FROM macro_daily GROUP BY ALL""",
    "pairs": """
SELECT * FROM (
  SELECT a.region_name, a.name, b.region_name AS neighbour_region, b.name AS neighbour,
         2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2)
           + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) * 1000 AS distance_m
  FROM macrozones a JOIN macrozones b ON a.name <> b.name)
WHERE distance_m <= 50000""",
    "variation": """
SELECT c.d AS day, p.region_name, p.macrozone_name, p.type, coalesce(m.avg_value, 0) AS current,
       p.avg_value AS previous, (coalesce(m.avg_value, 0) - p.avg_value) / p.avg_value * 100 AS delta_perc
FROM (SELECT d, CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) - 1, 3, 1)
                     ELSE make_date(year(d) - 1, month(d), day(d)) END AS before
      FROM (SELECT unnest(generate_series(TIMESTAMP '1996-01-02', TIMESTAMP '2001-11-04', INTERVAL 1 DAY)) AS d)) c
JOIN macro_daily p ON p.day = c.before
LEFT JOIN macro_daily m ON m.day = c.d AND m.region_name = p.region_name
     AND m.macrozone_name = p.macrozone_name AND m.type = p.type
WHERE p.avg_value <> 0""",
}

_WORD = re.compile(r"[a-z_]+")


def with_views(body: str) -> str:
    """Prefix a statement with the views it needs, transitively, in definition order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(_WORD.findall(sql)) & VIEWS.keys() - needed:
            needed.add(word)
            visit(VIEWS[word])

    visit(body)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    recursive = body.lstrip().startswith("RECURSIVE ")
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.lstrip()
    if recursive:
        return head + ",\n".join([*ctes, body[len("RECURSIVE "):]])
    return head + ",\n".join(ctes) + "\n" + body if ctes else body


# Numbers are compared after rounding. Data with two decimals gives many exact halves, which
# engines round differently by the last bit; both sides therefore add this part of the last
# digit first.
NUDGE = 0.13


def nudge(digits: int) -> float:
    return float(f"{NUDGE}e-{digits}")


def _nudged(sql: str) -> str:
    """``round(x, d)`` -> ``round(x + nudge, d)``, inner calls first."""
    start = 0
    while (at := sql.find("round(", start)) >= 0:
        depth, i, comma = 1, at + 6, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        if comma is not None:
            digits = int(sql[comma + 1 : i - 1])
            inner = _nudged(sql[at + 6 : comma])
            new = f"round({inner} + {nudge(digits)!r}, {digits})"
            sql = sql[:at] + new + sql[i:]
            start = at + len(new)
        else:
            start = at + 6
    return sql


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a function of ``Tables`` under an operator id, with its SQL where there is one."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(_nudged(sql))
        return fn

    return add
