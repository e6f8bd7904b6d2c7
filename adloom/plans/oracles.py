"""Reference SQL (DuckDB dialect) of the registered queries, on the same tables."""

from __future__ import annotations

import re

from adloom.operators.tags import TAG_RULES, UPDATE_FREQ, Thresholds
from adloom.plans.stored_queries import OTHER_DAY
from adloom.plans.queries import DAY, HOT, HOT_SHARE, PLACES, SCALED, SKEW_KEYS

TIME = "%Y-%m-%d %H:%M:%S.%f"


def exact(value: str, digits: int = 5) -> str:
    """Half-up rounding of a float sum or of a quotient of such; the engine's own ``round`` differs on ties."""
    return f"CAST(round(CAST(({value}) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def ratio(num: str, den: str) -> str:
    """Guarded count ratio, rounded half-up to five digits."""
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE floor(({num}) * 100000.0 / ({den}) + 0.5) / 100000.0 END)"


def money_ratio(num: str, den: str) -> str:
    """Guarded ratio with a float sum, rounded half-up to five digits."""
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE {exact(f'({num}) / ({den})')} END)"


def shown_time(column: str) -> str:
    return f"strftime({column}, '{TIME}')"


def _choice(number: str, *values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][({number}) % {len(values)} + 1]"


def _counted(key: str, *names: str) -> str:
    """Rows of the three kinds under the given names; nothing is counted for a missing key."""
    kinds = zip(("impression", "click", "conversion"), names, strict=True)
    return ", ".join(f"count(*) FILTER (kind = '{kind}' AND {key} IS NOT NULL) AS {name}" for kind, name in kinds)


_DEVICE = _choice("event_id", "ios", "android", "web", "h5")

# Named subqueries, in dependency order. A query takes those up to the one it needs.
CTES: dict[str, str] = {
    "activity": """
        SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS dt, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
        FROM events""",
    # With repeated rows: an earlier copy of some, and of others one of the same time with another ad.
    "logged": """
        SELECT * FROM activity UNION ALL BY NAME
        SELECT * REPLACE (ts - INTERVAL 1 MINUTE AS ts) FROM activity WHERE event_id % 10 = 0 UNION ALL BY NAME
        SELECT * REPLACE (k + 1 AS k) FROM activity WHERE event_id % 30 = 7""",
    "ev": f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_time, dt, user_id,
               CAST(NULL AS VARCHAR) AS session_id, 'ad_' || k AS ad_id, 'cmp_' || (k % 20) AS campaign_id,
               'creative_' || k AS creative_id, 'site_' || (event_id % 10) AS site_id,
               'page_' || logged.event_type AS page_id,
               CAST(event_id % 26 AS VARCHAR) AS ad_slot_id, {_DEVICE} AS device, {_DEVICE} || ' browser' AS user_agent,
               '10.0.' || (event_id % 256) || '.' || k AS ip,
               CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS is_valid,
               CASE WHEN event_type = 'click' THEN 'click' ELSE 'impression' END AS event_type
        FROM logged WHERE logged.event_type <> 'purchase'""",
    "conv": """
        SELECT CAST(event_id AS VARCHAR) AS conv_id, ts AS conv_time, dt, user_id, 'ad_' || k AS ad_id,
               'cmp_' || (k % 20) AS campaign_id, 'ord_' || event_id AS order_id, value AS gmv_amount
        FROM logged WHERE event_type = 'purchase'""",
    "cost_log": """
        SELECT dt, 'cmp_' || (k % 20) AS campaign_id, value AS cost FROM activity WHERE event_type = 'view'""",
    "ads": """
        SELECT 'ad_' || p_partkey AS ad_id, 'cmp_' || (p_partkey % 20) AS campaign_id,
               NULLIF(p_brand, 'Brand#1') AS advertiser_id, p_type AS ad_type,
               CASE WHEN p_size % 2 = 0 THEN 'app' ELSE 'web' END AS landing_type,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS product_id,
               '2023-12-25' AS start_dt, '2024-02-05' AS end_dt
        FROM part""",
    "slots": f"""
        SELECT CAST(n_nationkey AS VARCHAR) AS ad_slot_id, n_name AS slot_type, CAST(n_regionkey AS VARCHAR) AS app,
               lower(substr(n_name, 1, 3)) AS position, 80.0::DOUBLE + n_nationkey AS price_factor
        FROM nation""",
    "users": """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS gender,
               CAST(c_custkey % 60 AS INTEGER) AS age, CAST(c_nationkey AS VARCHAR) AS region,
               c_mktsegment AS device_type, '2023-06-01' AS register_dt
        FROM customer""",
    "enriched": """
        SELECT e.*, a.advertiser_id, a.ad_type, a.landing_type, a.product_id,
               s.slot_type, s.app, s.position, s.price_factor
        FROM ev e LEFT JOIN ads a ON e.ad_id = a.ad_id AND e.campaign_id = a.campaign_id
        LEFT JOIN slots s ON e.ad_slot_id = s.ad_slot_id""",
    "detail": """
        SELECT * EXCLUDE (is_valid) FROM enriched WHERE coalesce(is_valid, 1) = 1
        QUALIFY row_number() OVER (PARTITION BY dt, event_id, event_type ORDER BY event_time DESC, user_id DESC, ad_id DESC, campaign_id DESC) = 1""",
    "imp": "SELECT * FROM detail WHERE event_type = 'impression'",
    "clk": "SELECT * FROM detail WHERE event_type = 'click'",
    "conv_enriched": """
        SELECT c.*, a.advertiser_id, a.product_id FROM conv c
        LEFT JOIN ads a ON c.ad_id = a.ad_id AND c.campaign_id = a.campaign_id""",
    "cvd": """
        SELECT * FROM conv_enriched
        QUALIFY row_number() OVER (PARTITION BY dt, conv_id ORDER BY conv_time DESC, user_id DESC, ad_id DESC, campaign_id DESC) = 1""",
    "day_cost": """
        SELECT dt, campaign_id, cost FROM cost_log WHERE campaign_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY dt, campaign_id ORDER BY cost DESC) = 1""",
    # Everything that happened, one row each; money is exact.
    "fact": """
        SELECT dt, campaign_id, advertiser_id, user_id, event_type AS kind, event_time AS moment, CAST(0 AS DECIMAL(18, 2)) AS money
        FROM detail
        UNION ALL BY NAME
        SELECT dt, campaign_id, advertiser_id, user_id, 'conversion' AS kind, conv_time AS moment,
               CAST(coalesce(gmv_amount, 0) AS DECIMAL(18, 2)) AS money FROM cvd""",
    # Advertisers of a campaign: those of impressions, and all on days whose impressions name none.
    "pairs": """
        SELECT dt, campaign_id, advertiser_id
        FROM (SELECT dt, campaign_id, advertiser_id, bool_or(kind = 'impression') AS shown FROM fact
              WHERE kind <> 'conversion' AND campaign_id IS NOT NULL AND advertiser_id IS NOT NULL GROUP BY ALL)
        QUALIFY shown OR NOT bool_or(shown) OVER (PARTITION BY dt)""",
    "adv_cost": """
        SELECT dt, advertiser_id, sum(cost / coalesce(sharing, 1)) AS cost
        FROM day_cost LEFT JOIN
             (SELECT *, count(*) OVER (PARTITION BY dt, campaign_id) AS sharing FROM pairs) USING (dt, campaign_id)
        GROUP BY ALL""",
    "campaign_raw": f"""
        SELECT dt, campaign_id, {_counted("campaign_id", "impressions", "clicks", "conversions")},
               coalesce(CAST(sum(money) FILTER (campaign_id IS NOT NULL) AS DOUBLE), 0.0) AS gmv_amount,
               coalesce(sum(spent) FILTER (campaign_id IS NOT NULL), 0.0) AS cost
        FROM (SELECT dt, campaign_id, kind, money, 0.0::DOUBLE AS spent FROM fact UNION ALL BY NAME
              SELECT dt, campaign_id, 'cost' AS kind, cost AS spent FROM day_cost)
        GROUP BY dt, campaign_id""",
    "advertiser_raw": f"""
        SELECT dt, advertiser_id, {_counted("advertiser_id", "impressions", "clicks", "conversions")},
               coalesce(CAST(sum(money) AS DOUBLE), 0.0) AS gmv_amount, coalesce(sum(spent), 0.0) AS cost
        FROM (SELECT dt, advertiser_id, kind, money, 0.0::DOUBLE AS spent FROM fact UNION ALL BY NAME
              SELECT dt, advertiser_id, 'cost' AS kind, cost AS spent FROM adv_cost)
        WHERE advertiser_id IS NOT NULL GROUP BY dt, advertiser_id""",
    "user_raw": f"""
        SELECT *, {ratio("clk_cnt", "imp_cnt")} AS ctr, {ratio("conv_cnt", "clk_cnt")} AS cvr
        FROM (SELECT dt, user_id, {_counted("user_id", "imp_cnt", "clk_cnt", "conv_cnt")},
                     coalesce(CAST(sum(money) FILTER (user_id IS NOT NULL) AS DOUBLE), 0.0) AS gmv_amount,
                     CASE WHEN user_id IS NULL THEN 0 ELSE greatest(
                       count(DISTINCT campaign_id) FILTER (kind = 'impression'),
                       count(DISTINCT campaign_id) FILTER (kind = 'click')) END AS active_campaign_cnt,
                     CASE WHEN user_id IS NOT NULL THEN max(moment) END AS last_event_time
              FROM fact GROUP BY dt, user_id)""",
    "features": f"""
        SELECT d.dt, d.user_id,
               CAST(sum(h.imp_cnt) AS BIGINT) AS feature_7d_impressions,
               CAST(sum(h.clk_cnt) AS BIGINT) AS feature_7d_clicks,
               CAST(sum(h.conv_cnt) AS BIGINT) AS feature_7d_conversions,
               {exact("sum(h.gmv_amount)", 6)} AS feature_7d_gmv,
               count_if(h.imp_cnt > 0 OR h.clk_cnt > 0) AS feature_7d_active_days,
               {ratio("sum(h.clk_cnt)", "sum(h.imp_cnt)")} AS feature_7d_ctr,
               {ratio("sum(h.conv_cnt)", "sum(h.clk_cnt)")} AS feature_7d_cvr,
               any_value(d.imp_cnt) AS feature_day_impressions, any_value(d.clk_cnt) AS feature_day_clicks,
               any_value(d.conv_cnt) AS feature_day_conversions, {exact("any_value(d.gmv_amount)", 6)} AS feature_day_gmv,
               max(h.last_event_time) AS last_event_time
        FROM user_raw d JOIN user_raw h ON d.user_id = h.user_id
         AND CAST(h.dt AS DATE) BETWEEN CAST(d.dt AS DATE) - 6 AND CAST(d.dt AS DATE)
        GROUP BY d.dt, d.user_id""",
    "kpi": f"""
        SELECT c.dt, CAST(sum(c.impressions) AS BIGINT) AS impressions, CAST(sum(c.clicks) AS BIGINT) AS clicks,
               CAST(sum(c.conversions) AS BIGINT) AS conversions, {exact("sum(c.gmv_amount)")} AS gmv,
               {exact("sum(c.cost)")} AS cost,
               {ratio("sum(c.clicks)", "sum(c.impressions)")} AS ctr,
               {ratio("sum(c.conversions)", "sum(c.clicks)")} AS cvr,
               {money_ratio("CAST(sum(CAST(c.gmv_amount AS DECIMAL(18, 2))) AS DOUBLE) * 1000.0", "sum(c.impressions)")} AS rpm,
               {money_ratio("sum(c.gmv_amount)", "any_value(u.n)")} AS arpu,
               any_value(u.n) AS active_users, {money_ratio("sum(c.gmv_amount)", "sum(c.cost)")} AS roi
        FROM campaign_raw c LEFT JOIN (SELECT dt, count(*) AS n FROM user_raw GROUP BY ALL) u ON c.dt = u.dt
        GROUP BY c.dt""",
    "campaign_rates": f"""
        SELECT *, {ratio("clicks", "impressions")} AS ctr, {ratio("conversions", "clicks")} AS cvr,
               {money_ratio("gmv_amount * 1000.0", "impressions")} AS rpm, {money_ratio("gmv_amount", "cost")} AS roi
        FROM campaign_raw""",
    "advertiser_rates": f"""
        SELECT *, {ratio("clicks", "impressions")} AS ctr, {ratio("conversions", "clicks")} AS cvr,
               {money_ratio("gmv_amount * 1000.0", "impressions")} AS rpm, {money_ratio("gmv_amount", "cost")} AS roi
        FROM advertiser_raw""",
    "ranking": f"""
        SELECT dt, campaign_id, impressions, clicks, conversions, {exact("gmv_amount")} AS gmv, {exact("cost")} AS cost,
               ctr, cvr, rpm, roi,
               CAST(row_number() OVER (PARTITION BY dt ORDER BY {exact("gmv_amount")} DESC, campaign_id) AS INTEGER)
                 AS rank_by_gmv,
               CAST(row_number() OVER (PARTITION BY dt ORDER BY roi DESC, campaign_id) AS INTEGER) AS rank_by_roi
        FROM campaign_rates""",
    "dashboard": f"""
        SELECT c.dt, c.advertiser_id, c.impressions, c.clicks, c.conversions, {exact("c.gmv_amount")} AS gmv,
               {exact("c.cost")} AS cost, c.ctr, c.cvr, c.roi,
               CASE WHEN p.gmv_amount <> 0 THEN {exact("(c.gmv_amount - p.gmv_amount) / p.gmv_amount")} END
                 AS revenue_growth_rate,
               CASE WHEN c.cost > 0 THEN 1 ELSE 0 END AS retention_flag
        FROM advertiser_rates c LEFT JOIN advertiser_raw p
          ON c.advertiser_id = p.advertiser_id AND CAST(p.dt AS DATE) = CAST(c.dt AS DATE) - 1""",
    "sk": f"""
        SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 100 < 80 THEN '{HOT}'
               ELSE 'cmp_' || (CAST(event_id AS BIGINT) // 100 % {SKEW_KEYS - 1} + 1) END AS campaign_id)
        FROM ev""",
}


def _rule_sql(t: Thresholds) -> list[str]:
    return [
        f"feature_7d_active_days >= {t.active_days}",
        f"feature_7d_ctr >= {t.ctr} AND feature_7d_impressions >= {t.ctr_impressions}",
        f"feature_7d_cvr >= {t.cvr} AND feature_7d_clicks >= {t.cvr_clicks}",
        f"feature_7d_gmv >= {t.gmv}",
        f"feature_day_clicks >= {t.day_clicks}",
        f"feature_day_impressions >= {t.day_impressions}",
        f"feature_day_conversions >= {t.day_conversions}",
        "feature_day_impressions > 0 AND feature_day_clicks = 0 AND feature_day_conversions = 0",
    ]


def _tagged_sql(t: Thresholds) -> str:
    names = ", ".join(
        f"CASE WHEN {rule} THEN '{r.tag_name}' END" for r, rule in zip(TAG_RULES, _rule_sql(t))
    )
    return f"SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS tag_list FROM features"


def _quality_cte(snapshot: str) -> str:
    listed = ", ".join(f"('{r.tag_name}')" for r in TAG_RULES)
    share = ratio("coalesce(any_value(a.n), 0)", "any_value(u.total)")
    return f"""
        SELECT u.dt, t.tag_name, coalesce(any_value(a.n), 0) AS tagged_user_cnt, any_value(u.total) AS total_user_cnt,
               {share} AS coverage_rate,
               {exact("coalesce(any_value(a.c1), 0.0)")} AS avg_ctr_tagged,
               {exact("coalesce(any_value(a.c2), 0.0)")} AS avg_cvr_tagged,
               coalesce(any_value(a.c3), 0.0) AS avg_gmv_tagged
        FROM (SELECT dt, count(*) AS total FROM {snapshot} GROUP BY dt) u
        CROSS JOIN (VALUES {listed}) t(tag_name)
        LEFT JOIN (SELECT dt, tag, count(DISTINCT user_id) AS n, avg(feature_7d_ctr) AS c1, avg(feature_7d_cvr) AS c2,
                          avg(feature_7d_gmv) AS c3
                   FROM (SELECT *, unnest(tag_list) AS tag FROM {snapshot}) GROUP BY dt, tag) a
          ON u.dt = a.dt AND t.tag_name = a.tag
        GROUP BY u.dt, t.tag_name"""


CTES["tagged"] = _tagged_sql(Thresholds())
CTES["tagged_scaled"] = _tagged_sql(SCALED)
CTES["quality"] = _quality_cte("tagged")
CTES["quality_scaled"] = _quality_cte("tagged_scaled")


def _mentioned(text: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text)}


def sql(select: str) -> str:
    """``select`` preceded by the named subqueries it builds on."""
    needed, fresh = set(), _mentioned(select)
    while fresh:
        needed |= fresh
        fresh = set().union(*[_mentioned(CTES[name]) for name in fresh]) - needed
    used = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + select


_EVENT = f"""event_id, {shown_time("event_time")} AS event_time, dt, user_id, session_id, ad_id, campaign_id,
    creative_id, site_id, page_id, ad_slot_id, device, user_agent, ip, is_valid, event_type"""
_DETAIL = f"""event_id, {shown_time("event_time")} AS event_time, dt, user_id, session_id, ad_id, campaign_id,
    creative_id, advertiser_id, ad_type, landing_type, product_id, site_id, page_id, ad_slot_id, slot_type, app,
    position, price_factor, device, user_agent, ip, event_type"""
_DAILY = f"""impressions, clicks, conversions, {exact("gmv_amount", 6)} AS gmv_amount, {exact("cost", 6)} AS cost,
    ctr, cvr, rpm, roi"""
_FEATURES = """feature_7d_impressions, feature_7d_clicks, feature_7d_conversions, feature_7d_gmv, feature_7d_ctr,
    feature_7d_cvr, feature_day_impressions, feature_day_clicks, feature_day_conversions, feature_day_gmv"""
_SNAPSHOT = f"""dt, user_id, array_to_string(tag_list, ',') AS tags, CAST(len(tag_list) AS INTEGER) AS tag_cnt,
    {_FEATURES}, {shown_time("last_event_time")} AS last_event_time"""
_QUALITY = f"""dt, tag_name, tagged_user_cnt, total_user_cnt, coverage_rate, avg_ctr_tagged, avg_cvr_tagged,
    {exact("avg_gmv_tagged", 9)} AS avg_gmv_tagged"""
_EFFECT = f"""dt, tag_name, coverage_rate, tagged_user_cnt, avg_ctr_tagged, avg_cvr_tagged,
    {exact("avg_gmv_tagged")} AS avg_gmv_tagged"""
_TOTALS = f"""SELECT dt, campaign_id, count_if(event_type = 'impression') AS impressions,
    count_if(event_type = 'click') AS clicks, count(*) AS valid_events,
    {shown_time("max(event_time)")} AS last_event_time FROM ev WHERE is_valid = 1 GROUP BY ALL"""
_SESSIONS = """
    SELECT dt, user_id, event_id, event_time,
           'sess_' || replace(dt, '-', '') || '_' || user_id || '_' || lpad(CAST(n AS VARCHAR), 3, '0') AS session_id
    FROM (SELECT *, CAST(sum(starts) OVER w AS INTEGER) AS n
          FROM (SELECT *, CASE WHEN lag(event_time) OVER v IS NULL
                             OR event_time - lag(event_time) OVER v > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts
                FROM ev WINDOW v AS (PARTITION BY dt, user_id ORDER BY event_time))
          WINDOW w AS (PARTITION BY dt, user_id ORDER BY event_time))"""


def _duplicates(table: str, key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT dt, {key} FROM {table} GROUP BY ALL HAVING count(*) > 1))"


def _gate_sql() -> str:
    """One row per check of the gate."""
    rows: list[tuple[str, str, str, str]] = []

    def add(layer: str, table: str, check: str, bad: str) -> None:
        rows.append((layer, table, check, bad))

    def bad_rows(source: str, condition: str) -> str:
        return f"(SELECT count(*) FROM {source} WHERE {condition})"

    def empty(source: str) -> str:
        return f"(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM {source})"

    add("ods", "ad_event_log", "not_empty", empty("ev"))
    for table, time, source in (
        ("ad_event_log", "event_time", None),
        ("conversion_log", "conv_time", None),
    ):
        add("ods", table, f"{time} is a timestamp", "0")
    for c in ("dt", "event_id", "campaign_id", "ad_id", "creative_id", "event_type"):
        add("ods", "ad_event_log", f"{c} not null", bad_rows("ev", f"{c} IS NULL"))
    add("ods", "ad_cost", "not_empty", empty("cost_log"))
    add("ods", "ad_cost", "cost >= 0", bad_rows("cost_log", "cost < 0"))
    for table, source, key, time in (
        ("ad_impression_detail", "imp", "event_id", "event_time"),
        ("ad_click_detail", "clk", "event_id", "event_time"),
        ("ad_conversion_detail", "cvd", "conv_id", "conv_time"),
    ):
        add("dwd", table, f"{time} is a timestamp", "0")
        add("dwd", table, f"unique (dt, {key})", _duplicates(source, key))

    def measures(layer: str, table: str, source: str, non_negative=(), rates=(), filled=False) -> None:
        if filled:
            add(layer, table, "not_empty", empty(source))
        for c in non_negative:
            add(layer, table, f"{c} >= 0", bad_rows(source, f"{c} < 0"))
        for c in rates:
            add(layer, table, f"{c} in [0,1]", bad_rows(source, f"{c} < 0 OR {c} > 1"))

    counted = ("impressions", "clicks", "conversions")
    measures("dws", "campaign_daily", "campaign_rates", (*counted, "gmv_amount", "cost", "roi"), ("ctr", "cvr"), True)
    measures("dws", "advertiser_daily", "advertiser_rates", (), ("ctr", "cvr"))
    measures("dws", "user_daily", "user_raw", ("imp_cnt", "clk_cnt", "conv_cnt", "gmv_amount"), ("ctr", "cvr"), True)
    measures("dws", "tag_quality_daily", "quality_scaled", (), ("coverage_rate",))
    more = bad_rows("quality_scaled", "tagged_user_cnt > total_user_cnt")
    add("dws", "tag_quality_daily", "tagged_user_cnt <= total_user_cnt", more)
    measures("ads", "kpi_overview_daily", "kpi", (*counted, "gmv", "cost", "active_users"), ("ctr", "cvr"), True)
    measures("ads", "campaign_ranking_daily", "ranking", (), ("ctr", "cvr"))
    add("ads", "advertiser_dashboard_daily", "revenue_growth_rate is finite", bad_rows("dashboard", "isinf(revenue_growth_rate)"))
    measures("ads", "tag_effectiveness_daily", "quality_scaled", (), ("coverage_rate",))

    unions = " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{table}' AS table_name, '{check}' AS check_name, CAST({bad} AS BIGINT) AS bad_rows"
        for layer, table, check, bad in rows
    )
    return f"SELECT *, bad_rows = 0 AS passed FROM ({unions})"


def _lost(table: str, source: str, conditions: dict[str, str]) -> str:
    """Rows of the landing report of one source."""
    return " UNION ALL ".join(
        f"SELECT 'ods' AS layer, '{table}' AS table_name, '{name}' AS measure, count_if({bad}) AS matching_rows, count(*) AS total_rows FROM {source}"
        for name, bad in conditions.items()
    )


def _turn(column: str, *remainders: int) -> str:
    return f"CAST({column} AS BIGINT) % 50 IN ({', '.join(map(str, remainders))})"


_LOSSES = " UNION ALL ".join(
    [
        _lost("ad_event_log", "ev", {"event_time lost": _turn("event_id", 7), "malformed line": _turn("event_id", 3, 4)}),
        _lost("conversion_log", "conv", {"conv_time lost": _turn("conv_id", 8), "gmv_amount lost": _turn("conv_id", 9), "malformed line": "false"}),
        _lost("user_profile", "users", {"age lost": _turn("user_id", 5), "register_dt lost": _turn("user_id", 7), "malformed line": "false"}),
        _lost("ad_slot", "slots", {"price_factor lost": "false", "malformed line": "ad_slot_id = '3'"}),
    ]
)


def _measures_sql() -> str:
    """One row for everything the steps of a build count; the rate of no rows is 1 where good rows are counted."""
    rows: list[str] = []

    def add(table: str, measure: str, matching: str, total: str, source: str, good: bool) -> None:
        layer, name = table.split(".")
        rows.append(
            f"SELECT '{layer}' AS layer, '{name}' AS table_name, '{measure}' AS measure, {matching} AS matching_rows, "
            f"{total} AS total_rows, {good} AS good FROM {source}"
        )

    def bounds(table: str, source: str, **limits: str) -> None:
        for metric, condition in limits.items():
            add(table, f"{metric} within bounds", f"count_if({metric} {condition})", "count(*)", source, True)

    def keyed(table: str, source: str, *keys: str) -> None:
        listed = ", ".join(keys)
        distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source}))"
        add(table, f"distinct ({listed})", distinct, "count(*)", source, True)

    unit, positive = "BETWEEN 0 AND 1", ">= 0"
    for kind, source in (("impression", "imp"), ("click", "clk")):
        table = f"dwd.ad_{kind}_detail"
        for c in ("advertiser_id", "slot_type"):
            add(table, f"{c} missing", f"count_if({c} IS NULL)", "count(*)", source, False)
        before = f"(SELECT count(*) FROM ev WHERE event_type = '{kind}')"
        add(table, "kept by filter and deduplication", "count(*)", before, source, True)
        keyed(table, source, "dt", "event_id")
    distinct = "(SELECT count(*) FROM (SELECT DISTINCT advertiser_id FROM imp))"
    add("dwd.ad_impression_detail", "distinct advertiser_id", distinct, "count(*)", "imp", True)
    add("dwd.ad_conversion_detail", "advertiser_id missing", "count_if(advertiser_id IS NULL)", "count(*)", "cvd", False)
    keyed("dwd.ad_conversion_detail", "cvd", "dt", "conv_id")
    for table, source, key in (
        ("dws.campaign_daily", "campaign_rates", "campaign_id"),
        ("dws.advertiser_daily", "advertiser_rates", "advertiser_id"),
    ):
        bounds(table, source, ctr=unit, cvr=unit, roi=positive)
        for rule in ("clicks > impressions", "conversions > clicks", "cost < 0", "gmv_amount < 0"):
            add(table, rule, f"count_if({rule})", "count(*)", source, False)
        keyed(table, source, "dt", key)
    bounds("dws.user_daily", "user_raw", ctr=unit, cvr=unit, gmv_amount=positive)
    keyed("dws.user_daily", "user_raw", "dt", "user_id")
    bounds("dws.tag_quality_daily", "quality_scaled", coverage_rate=unit)
    keyed("dws.tag_quality_daily", "quality_scaled", "dt", "tag_name")
    bounds("ads.kpi_overview_daily", "kpi", ctr=unit, cvr=unit, roi=positive)
    keyed("ads.kpi_overview_daily", "kpi", "dt")
    bounds("ads.campaign_ranking_daily", "ranking", ctr=unit, cvr=unit)
    keyed("ads.campaign_ranking_daily", "ranking", "dt", "campaign_id")
    keyed("ads.advertiser_dashboard_daily", "dashboard", "dt", "advertiser_id")
    bounds("ads.tag_effectiveness_daily", "quality_scaled", coverage_rate=unit)
    keyed("ads.tag_effectiveness_daily", "quality_scaled", "dt", "tag_name")
    rate = f"CASE WHEN total_rows = 0 AND good THEN 1.0 ELSE {ratio('matching_rows', 'total_rows')} END"
    return f"SELECT * EXCLUDE (good), {rate} AS rate FROM ({' UNION ALL '.join(rows)})"


_VERDICT = """
    SELECT count(*) = 0 AS passed, count(*) AS failed_checks, coalesce(string_agg(line, chr(10) ORDER BY line), '') AS messages FROM (
      SELECT 'dws.campaign_daily: ' || name || ': ' || n || ' rows' AS line, n FROM (
        SELECT 'cost >= 0' AS name, count_if(campaign_id = 'cmp_3' AND -cost - 1 < 0) AS n FROM campaign_rates UNION ALL
        SELECT 'ctr in [0,1]' AS name, count_if(campaign_id = 'cmp_4' OR ctr NOT BETWEEN 0 AND 1) AS n FROM campaign_rates UNION ALL
        SELECT 'cvr in [0,1]' AS name, count_if(cvr NOT BETWEEN 0 AND 1) AS n FROM campaign_rates) UNION ALL
      SELECT 'dwd.ad_event_detail: unique (dt, event_id): ' || n || ' rows' AS line, n FROM (
        SELECT count(*) AS n FROM (SELECT dt, event_id FROM ev GROUP BY ALL HAVING count(*) > 1))
    ) WHERE n > 0"""

_DICTIONARY = ", ".join(
    f"('{r.tag_id}', '{r.tag_name}', '{r.tag_type}', '{r.rule_desc}', '{UPDATE_FREQ}')" for r in TAG_RULES
)
_PAIR = "SELECT dt, {0} FROM imp UNION SELECT dt, {0} FROM clk UNION SELECT dt, {0} FROM cvd"
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_rows FROM ev"
    for c in ("dt", "event_id", "campaign_id", "ad_id", "creative_id", "event_type", "session_id", "is_valid")
)
_MD5_AD = "CAST(('0x' || substr(md5(ad_id), 1, 8)) AS BIGINT)"
_MD5_CAMPAIGN = "CAST(('0x' || substr(md5(campaign_id), 1, 8)) AS BIGINT)"

SELECTS: dict[str, str] = {
    "land_events": f"SELECT {_EVENT} FROM ev",
    "land_conversions": f"SELECT * REPLACE ({shown_time('conv_time')} AS conv_time) FROM conv",
    "land_cost": "SELECT * FROM cost_log",
    "land_user_profile": "SELECT * FROM users",
    "land_ad_meta": "SELECT * FROM ads",
    "land_ad_slot": "SELECT * FROM slots",
    "first_nonempty_cost": f"SELECT * FROM day_cost WHERE dt = '{DAY}'",
    "day_scan": f"SELECT {_EVENT} FROM ev WHERE dt = '{DAY}'",
    "last7_scan": f"SELECT {_EVENT} FROM ev WHERE CAST(dt AS DATE) BETWEEN DATE '{DAY}' - 6 AND DATE '{DAY}'",
    "discover_dts": "SELECT DISTINCT dt FROM ev ORDER BY dt",
    "overwrite_day": f"SELECT dt, campaign_id, CASE WHEN dt = '{DAY}' THEN cost * 2 ELSE cost END AS cost FROM day_cost",
    "std_events": f"SELECT {_EVENT} FROM ev",
    "std_conversions": f"SELECT * REPLACE ({shown_time('conv_time')} AS conv_time) FROM conv",
    "std_cost": "SELECT * FROM cost_log",
    "dim_user": "SELECT * FROM users",
    "dim_ad": "SELECT * FROM ads",
    "dim_ad_slot": "SELECT * FROM slots",
    "dim_snapshot": f"SELECT * FROM ads, (VALUES ('2024-01-29'), ('{DAY}')) d(dt)",
    "backfill_columns": f"""SELECT event_id, {shown_time("event_time")} AS event_time, dt, user_id, ad_id, campaign_id,
        creative_id, site_id, event_type, device, CAST(NULL AS VARCHAR) AS session_id,
        CAST(NULL AS VARCHAR) AS ad_slot_id, CAST(NULL AS VARCHAR) AS page_id, 1 AS is_valid,
        CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS user_agent FROM ev""",
    "valid_events": f"""SELECT {_EVENT} FROM (
        SELECT * REPLACE (CASE WHEN event_type <> 'click' THEN is_valid END AS is_valid) FROM ev)
        WHERE is_valid IS NULL OR is_valid = 1""",
    "device_type": f"""SELECT event_id, {shown_time("event_time")} AS event_time, device,
        CASE device WHEN 'ios' THEN 'ios' WHEN 'android' THEN 'android' ELSE 'web' END AS device_type,
        CASE device WHEN 'ios' THEN 'ios_app' WHEN 'android' THEN 'android_app' ELSE 'web' END AS agent FROM ev""",
    "md5_bucket": f"""SELECT event_id, {shown_time("event_time")} AS event_time, ad_id,
        CAST({_MD5_AD} % 50 AS INTEGER) AS bucket,
        'adv_' || lpad(CAST({_MD5_CAMPAIGN} % 50 + 1 AS VARCHAR), 3, '0') AS advertiser FROM ev""",
    "enrich_events": f"""SELECT {_EVENT}, advertiser_id, ad_type, landing_type, product_id, slot_type, app, position,
        price_factor FROM enriched""",
    "enrich_conversions": f"SELECT * REPLACE ({shown_time('conv_time')} AS conv_time) FROM conv_enriched",
    "impression_detail": f"SELECT {_DETAIL} FROM imp",
    "click_detail": f"SELECT {_DETAIL} FROM clk",
    "conversion_detail": f"SELECT * REPLACE ({shown_time('conv_time')} AS conv_time) FROM cvd",
    "campaign_day_cost": "SELECT * FROM day_cost",
    "campaign_spine": _PAIR.format("campaign_id") + " UNION SELECT dt, campaign_id FROM day_cost",
    "advertiser_spine": f"SELECT * FROM ({_PAIR.format('advertiser_id')}) WHERE advertiser_id IS NOT NULL",
    "user_spine": _PAIR.format("user_id"),
    "event_union": f"SELECT {_DETAIL} FROM imp UNION ALL SELECT {_DETAIL} FROM clk",
    "campaign_advertiser_map": "SELECT * FROM pairs",
    "advertiser_cost_split": f"SELECT dt, advertiser_id, {exact('cost', 6)} AS cost FROM adv_cost",
    "campaign_daily": f"SELECT dt, campaign_id, {_DAILY} FROM campaign_rates",
    "advertiser_daily": f"SELECT dt, advertiser_id, {_DAILY} FROM advertiser_rates",
    "user_daily": f"""SELECT * REPLACE ({exact("gmv_amount", 6)} AS gmv_amount,
        {shown_time("last_event_time")} AS last_event_time) FROM user_raw""",
    "imp_click_full_outer": """SELECT coalesce(i.dt, c.dt) AS dt, coalesce(i.campaign_id, c.campaign_id) AS campaign_id,
        coalesce(i.n, 0) AS impressions, coalesce(c.n, 0) AS clicks
        FROM (SELECT dt, campaign_id, count(*) AS n FROM ev WHERE event_type = 'impression' GROUP BY ALL) i
        FULL JOIN (SELECT dt, campaign_id, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY ALL) c
          ON i.dt = c.dt AND i.campaign_id = c.campaign_id""",
    "media_cost": f"""SELECT dt, campaign_id, {exact(
        "i * coalesce(CASE WHEN n_regionkey <> 0 THEN 10.0::DOUBLE + n_nationkey END, 30.0) / 1000.0"
        " + c * coalesce(CASE WHEN n_regionkey <> 0 THEN 0.5::DOUBLE + n_nationkey / 16.0 END, 1.0)", 4
        )} AS cost
        FROM (SELECT dt, campaign_id, count_if(event_type = 'impression')::DOUBLE AS i,
                     count_if(event_type = 'click')::DOUBLE AS c FROM ev GROUP BY ALL) t
        LEFT JOIN nation ON t.campaign_id = 'cmp_' || n_nationkey
        ORDER BY dt, campaign_id""",
    "user_features_7d": f"""SELECT dt, user_id, {_FEATURES}, feature_7d_active_days,
        {shown_time("last_event_time")} AS last_event_time FROM features""",
    "user_features_day": f"""SELECT dt, user_id, {_FEATURES}, feature_7d_active_days,
        {shown_time("last_event_time")} AS last_event_time FROM features WHERE dt = '{DAY}'""",
    "user_tag_snapshot": f"SELECT {_SNAPSHOT} FROM tagged",
    "user_tag_snapshot_scaled": f"SELECT {_SNAPSHOT} FROM tagged_scaled",
    "user_tag_snapshot_day": f"SELECT {_SNAPSHOT} FROM tagged WHERE dt = '{DAY}'",
    "tag_explode": """SELECT dt, user_id, feature_7d_ctr, feature_7d_cvr, feature_7d_gmv,
        unnest(CASE WHEN len(tag_list) = 0 THEN [NULL] ELSE tag_list END) AS tag_name FROM tagged_scaled""",
    "tag_quality_daily": f"SELECT {_QUALITY} FROM quality",
    "tag_quality_scaled": f"SELECT {_QUALITY} FROM quality_scaled",
    "tag_dict": f"""SELECT d.*, coalesce(t.n, 0) AS tagged_user_days
        FROM (VALUES {_DICTIONARY}) d(tag_id, tag_name, tag_type, rule_desc, update_freq)
        LEFT JOIN (SELECT tag, count(*) AS n FROM (SELECT unnest(tag_list) AS tag FROM tagged_scaled) GROUP BY tag) t
          ON d.tag_name = t.tag""",
    "kpi_overview": "SELECT * FROM kpi",
    "campaign_ranking": "SELECT * FROM ranking",
    "advertiser_dashboard": "SELECT * FROM dashboard",
    "tag_effectiveness": f"SELECT {_EFFECT} FROM quality_scaled",
    "kpi_lookup": f"SELECT * FROM kpi WHERE dt = '{DAY}'",
    "top_campaigns_gmv": f"SELECT * FROM ranking WHERE dt = '{DAY}' ORDER BY rank_by_gmv LIMIT 10",
    "top_campaigns_roi": f"SELECT * FROM ranking WHERE dt = '{DAY}' ORDER BY rank_by_roi LIMIT 10",
    "top_advertisers_gmv": f"SELECT * FROM dashboard WHERE dt = '{DAY}' ORDER BY gmv DESC, advertiser_id LIMIT 10",
    "tag_report": f"SELECT {_EFFECT} FROM quality_scaled WHERE dt = '{DAY}' ORDER BY coverage_rate DESC, tag_name",
    "skew_simple": """SELECT dt, campaign_id, count(*) AS impressions FROM ev
        WHERE is_valid = 1 AND event_type = 'impression' GROUP BY ALL""",
    "skew_totals": _TOTALS,
    "skew_plain": _TOTALS,
    "skew_salted": _TOTALS,
    "skew_salted_combined": _TOTALS,
    "hot_keys": f"""SELECT campaign_id, row_cnt, share FROM (SELECT campaign_id, count(*) AS row_cnt,
        {ratio("count(*)", "(SELECT count(*) FROM ev)")} AS share FROM ev GROUP BY campaign_id) WHERE share >= {HOT_SHARE}""",
    "partition_balance": f"""SELECT CAST(min(n) AS DOUBLE) AS least_rows, CAST(max(n) AS DOUBLE) AS most_rows,
        {exact("avg(n)", 2)} AS mean_rows, {exact("max(n) / avg(n)", 2)} AS most_over_mean
        FROM (SELECT CAST({_MD5_CAMPAIGN} % {PLACES} AS INTEGER) AS place, count(*) AS n FROM ev WHERE is_valid = 1 GROUP BY ALL)""",
    "rekey_skewed": f"SELECT event_id, {shown_time('event_time')} AS event_time, campaign_id FROM sk",
    "rekey_uniform": f"""SELECT event_id, {shown_time("event_time")} AS event_time,
        'cmp_' || (CAST(event_id AS BIGINT) % {SKEW_KEYS}) AS campaign_id FROM ev""",
    "sessionize": f"SELECT * REPLACE ({shown_time('event_time')} AS event_time) FROM ({_SESSIONS})",
    "user_device_pref": """SELECT user_id, kind AS device_type FROM (
        SELECT user_id, CASE WHEN device IN ('ios', 'android') THEN device ELSE 'web' END AS kind, count(*) AS n
        FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, kind) = 1""",
    "dataset_summary": f"""SELECT event_rows, impressions, clicks, {ratio("clicks", "impressions")} AS ctr, conversions,
        {ratio("conversions", "clicks")} AS cvr, {ratio("hot", "impressions")} AS hot_share,
        distinct_users, distinct_ads, distinct_campaigns
        FROM (SELECT count(*) AS event_rows, count_if(event_type = 'impression') AS impressions,
                     count_if(event_type = 'click') AS clicks,
                     count_if(event_type = 'impression' AND campaign_id = 'cmp_0') AS hot,
                     (SELECT count(*) FROM conv) AS conversions, count(DISTINCT user_id) AS distinct_users,
                     count(DISTINCT ad_id) AS distinct_ads, count(DISTINCT campaign_id) AS distinct_campaigns FROM ev)""",
    "product_distribution": f"""SELECT CAST(rank AS INTEGER) AS rank, product_id, product_cnt,
        CAST(total AS BIGINT) AS total_nonempty, n AS distinct_products, {ratio("listed", "total")} AS top_share,
        {ratio("wide", "total")} AS wide_share
        FROM (SELECT *, row_number() OVER o AS rank, sum(product_cnt) OVER () AS total, count(*) OVER () AS n,
                     sum(product_cnt) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS unused,
                     (SELECT sum(c) FROM (SELECT count(*) AS c FROM ads WHERE product_id IS NOT NULL GROUP BY product_id
                      ORDER BY c DESC, product_id LIMIT 10)) AS listed,
                     (SELECT sum(c) FROM (SELECT count(*) AS c FROM ads WHERE product_id IS NOT NULL GROUP BY product_id
                      ORDER BY c DESC, product_id LIMIT 100)) AS wide
              FROM (SELECT product_id, count(*) AS product_cnt FROM ads WHERE product_id IS NOT NULL GROUP BY product_id)
              WINDOW o AS (ORDER BY product_cnt DESC, product_id))
        WHERE rank <= 10""",
    "dq_report": _gate_sql(),
    "dq_landing_losses": f"SELECT *, {ratio('matching_rows', 'total_rows')} AS rate FROM ({_LOSSES})",
    "dq_build_measures": _measures_sql(),
    "dq_verdict": _VERDICT,
    "csv_files": f"""SELECT event_id, CASE WHEN {_turn("event_id", 7)} THEN NULL ELSE {shown_time("event_time")} END AS event_time, dt, user_id, ad_id,
        CASE WHEN {_turn("event_id", 3)} THEN NULL ELSE is_valid END AS is_valid, ip,
        CASE WHEN {_turn("event_id", 4)} THEN 'one' ELSE user_agent END AS user_agent, {_turn("event_id", 3, 4)} AS malformed FROM ev""",
    "catalog_read": "SELECT campaign_id, cost, dt FROM day_cost",
    "insert_day": f"""SELECT campaign_id, CASE WHEN dt = '{DAY}' THEN cost * 3 ELSE cost END AS cost, dt FROM day_cost
        WHERE dt <> '{OTHER_DAY}'""",
    "replace_table": """SELECT *, 'before' AS version FROM slots UNION ALL
        SELECT * REPLACE (price_factor + 1 AS price_factor), 'after' AS version FROM slots WHERE app <> '0'""",
    "file_sizing": "SELECT dt, CAST(1 AS BIGINT) AS files, count(*) AS row_cnt, true AS has_bytes FROM day_cost GROUP BY dt",
    "partition_days": "SELECT source, dt FROM (SELECT DISTINCT dt FROM day_cost), (VALUES ('path'), ('catalog')) s(source)",
    "first_nonempty_stored": f"SELECT * FROM day_cost WHERE dt = '{DAY}'",
    "dq_nulls": _NULLS,
    "dq_duplicates": "SELECT dt, event_id, count(*) AS row_cnt FROM ev GROUP BY ALL HAVING count(*) > 1",
    "dq_pk_rate": f"""SELECT total_rows, distinct_keys, {ratio("distinct_keys", "total_rows")} AS unique_rate
        FROM (SELECT count(*) AS total_rows, count(DISTINCT (dt, event_id)) AS distinct_keys FROM ev)""",
    "dq_filter_effect": f"""SELECT dt, event_type, before_rows, after_rows, {ratio("after_rows", "before_rows")} AS kept_rate
        FROM (SELECT dt, event_type, count(*) AS before_rows,
                     count(DISTINCT CASE WHEN coalesce(is_valid, 1) = 1 THEN event_id END) AS after_rows
              FROM ev GROUP BY ALL)""",
    "dq_missing_rate": f"""SELECT *, {ratio("advertiser_id_missing", "total_rows")} AS advertiser_id_missing_rate,
        {ratio("slot_type_missing", "total_rows")} AS slot_type_missing_rate
        FROM (SELECT dt, count(*) AS total_rows, count_if(advertiser_id IS NULL) AS advertiser_id_missing,
                     count_if(slot_type IS NULL) AS slot_type_missing, count(DISTINCT advertiser_id) AS advertisers
              FROM imp GROUP BY ALL)""",
    "dq_logic": """
        SELECT 'clicks > impressions' AS rule, count_if(clicks > impressions) AS bad_rows FROM campaign_rates UNION ALL
        SELECT 'conversions > clicks', count_if(conversions > clicks) FROM campaign_rates UNION ALL
        SELECT 'cost < 0', count_if(cost < 0) FROM campaign_rates UNION ALL
        SELECT 'gmv_amount < 0', count_if(gmv_amount < 0) FROM campaign_rates""",
    "dq_metric_sanity": f"""SELECT metric, ok_rows, total_rows, {ratio("ok_rows", "total_rows")} AS ok_rate FROM (
        SELECT 'ctr' AS metric, count_if(ctr BETWEEN 0 AND 1) AS ok_rows, count(*) AS total_rows FROM campaign_rates
        UNION ALL SELECT 'cvr', count_if(cvr BETWEEN 0 AND 1), count(*) FROM campaign_rates
        UNION ALL SELECT 'roi', count_if(roi >= 0), count(*) FROM campaign_rates)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(select) for name, select in SELECTS.items()}
