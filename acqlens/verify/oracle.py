"""DuckDB SQL for every registered query, stated over the driver's base tables.

The statements do not repeat the operators' plan. All money is integer cents;
two wide facts carry everything else:

* ``person``: one row per customer with the measures of its orders (all, inside
  its campaign's run, in its first 90 days) and its months on file;
* ``effort``: one row per campaign with spend, leads and the sums of its people.

Retention comes from ``step`` (distinct customers per month after signup, read off
the orders) and from counting who has been on file long enough; there is no
customer-month table but where a query returns one. The check suites are
generated from a list of (name, kind, arguments).

Ratios are rounded exactly on integers, half away from zero (``near``), because
DuckDB divides decimals in DOUBLE. Results are DOUBLE, BIGINT, BOOLEAN or text;
dates are returned as ISO text.
"""

from __future__ import annotations

# ------------------------------------------------------------------ expressions


def near(num: str, den: str) -> str:
    """num / den as the nearest integer, half away from zero; NULL for den = 0."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return f"(CASE WHEN {d} <> 0 THEN sign({n}) * sign({d}) * ((2 * abs({n}) + abs({d})) // (2 * abs({d}))) END)"


def hundredths(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) / 100)"


def pct(num: str, den: str) -> str:
    return hundredths(near(f"10000 * ({num})", den))


def ratio(num: str, den: str) -> str:
    """Two digits of num / den for amounts of one unit."""
    return hundredths(near(f"100 * ({num})", den))


def each(cents: str, n: str) -> str:
    """Money per unit, rounded to cents."""
    return hundredths(near(cents, n))


def n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def day(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


def months(x: str) -> str:
    return f"(year({x}) * 12 + month({x}))"


# ------------------------------------------------------------------ facts

PARTS: dict[str, str] = {
    "medium": "SELECT CAST(r_regionkey AS INTEGER) AS medium_id, r_name AS title FROM region",
    "ad": """
      SELECT k AS ad_id, CAST(n_regionkey AS INTEGER) AS medium_id, n_name AS ad_title, opens,
             CAST(opens + CAST(90 + 20 * (k % 5) AS INTEGER) AS DATE) AS closes,
             (['Lead Generation', 'Conversions', 'Brand Awareness', 'Retargeting'])[k % 4 + 1] AS goal
      FROM (SELECT *, CAST(n_nationkey AS INTEGER) AS k, make_date(1995 + n_nationkey % 6, 1 + n_nationkey % 12, 1) AS opens
            FROM nation)""",
    "placed": "SELECT ad.*, title FROM ad JOIN medium USING (medium_id)",
    "buy": """
      SELECT o_orderkey AS buy_id, o_custkey AS who, CAST(o_orderdate AS DATE) AS on_day,
             CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c
      FROM orders""",
    "today": "SELECT max(on_day) AS t FROM buy",
    "client": """
      SELECT c_custkey AS who, CAST(c_nationkey AS INTEGER) AS ad_id, c_mktsegment AS area,
             CAST(coalesce(b.first_at, DATE '1996-01-01')
                  + CAST(CASE WHEN c_custkey % 40 = 11 THEN 20 ELSE -(c_custkey % 4) END AS INTEGER) AS DATE) AS joined
      FROM customer LEFT JOIN (SELECT who, min(on_day) AS first_at FROM buy GROUP BY who) b ON b.who = c_custkey""",
    "outlay": """
      SELECT CAST(s_nationkey AS INTEGER) AS ad_id, CAST(l_shipdate AS DATE) AS on_day,
             CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) * 100
                  AS BIGINT) AS c, CAST(sum(l_quantity) AS BIGINT) AS shown, count(*) AS clicked
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
      WHERE s_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY ALL""",
    "contact": """
      SELECT who * 2 AS contact_id, ad_id, joined AS on_day, TRUE AS won, who FROM client
      UNION ALL
      SELECT event_id * 2 + 1, CAST(user_id % (SELECT count(*) FROM nation) AS INTEGER), CAST(ts AS DATE), FALSE, NULL FROM events""",
    "person": f"""
      SELECT c.who, c.ad_id, c.area, c.joined, p.medium_id, p.title, count(b.on_day) AS n, count(b.buy_id) AS n_ids,
             sum(b.c) AS c_all, coalesce(sum(b.c), 0) AS c0,
             coalesce(sum(b.c) FILTER (b.on_day BETWEEN p.opens AND p.closes), 0) AS c_run,
             coalesce(sum(b.c) FILTER (b.on_day <= c.joined + 90), 0) AS c_90,
             min(b.on_day) AS first_at, max(b.on_day) AS last_at, c.joined + 90 <= any_value(t) AS past_90,
             any_value({months('t')}) - {months('c.joined')} AS on_file
      FROM client c JOIN placed p USING (ad_id) CROSS JOIN today LEFT JOIN buy b USING (who)
      GROUP BY c.who, c.ad_id, c.area, c.joined, p.medium_id, p.title""",
    "effort": """
      SELECT placed.*, s.c AS spent, s.shown, s.clicked, s.since, s.until, l.leads, l.wins, l.gained,
             p.life, p.run, p.people, p.s90, p.n90
      FROM placed
      LEFT JOIN (SELECT ad_id, sum(c) AS c, sum(shown) AS shown, sum(clicked) AS clicked, min(on_day) AS since, max(on_day) AS until
                 FROM outlay GROUP BY ad_id) s USING (ad_id)
      LEFT JOIN (SELECT ad_id, count(*) AS leads, count_if(won) AS wins, count(DISTINCT who) AS gained
                 FROM contact GROUP BY ad_id) l USING (ad_id)
      LEFT JOIN (SELECT ad_id, sum(c0) AS life, sum(c_run) AS run, count(*) AS people,
                        sum(c_90) FILTER (past_90) AS s90, count(*) FILTER (past_90) AS n90
                 FROM person GROUP BY ad_id) p USING (ad_id)""",
    "reach": """
      SELECT title, sum(spent) AS spent, sum(leads) AS leads, sum(wins) AS wins, sum(gained) AS gained,
             sum(run) AS run, sum(life) AS life
      FROM effort WHERE spent IS NOT NULL AND leads IS NOT NULL AND people IS NOT NULL GROUP BY title""",
    "worth": """
      SELECT title, count(*) AS people, sum(c0) AS life, sum(n_ids) AS n_ids, sum(c_90) FILTER (past_90) AS s90,
             count(*) FILTER (past_90) AS n90, count(*) FILTER (NOT past_90) AS rest
      FROM person GROUP BY title""",
    "step": f"""
      SELECT who, medium_id, title, {month('joined')} AS cohort, {months('on_day')} - {months('joined')} AS age,
             count(*) AS n, sum(c) AS c
      FROM person JOIN buy USING (who) WHERE {month('on_day')} >= {month('joined')} GROUP BY ALL""",
    "ages": "SELECT unnest(generate_series(0, (SELECT max(on_file) FROM person))) AS age",
    "kept": """
      SELECT medium_id, title, age, people, coalesce(active, 0) AS active
      FROM (SELECT medium_id, title, age, count(*) AS people FROM person JOIN ages ON age <= on_file GROUP BY ALL)
      LEFT JOIN (SELECT medium_id, title, age, count(DISTINCT who) AS active FROM step GROUP BY ALL) USING (medium_id, title, age)""",
    "cohorts": f"SELECT {month('joined')} AS cohort, count(*) AS size FROM client GROUP BY 1",
    "cell": f"""
      SELECT cohort, age, size, coalesce(active, 0) AS active, coalesce(c, 0) AS c,
             sum(coalesce(c, 0)) OVER (PARTITION BY cohort ORDER BY age) AS c_so_far
      FROM (SELECT DISTINCT {month('joined')} AS cohort, age FROM person JOIN ages ON age <= on_file)
      JOIN cohorts USING (cohort)
      LEFT JOIN (SELECT cohort, age, count(DISTINCT who) AS active, sum(c) AS c FROM step GROUP BY ALL) USING (cohort, age)""",
    "scored": """
      SELECT *, t - last_at AS idle, NTILE(5) OVER (ORDER BY t - last_at DESC, who) AS r,
             NTILE(5) OVER (ORDER BY n, who) AS f, NTILE(5) OVER (ORDER BY c_all, who) AS m
      FROM person CROSS JOIN today WHERE n > 0""",
    "client_score": f"""
      SELECT who, joined, CASE WHEN last_at IS NULL THEN 10000
             ELSE least({near('(t - last_at) * 10000', '365')}, 10000) END AS risk
      FROM (SELECT who, joined, max(on_day) AS last_at FROM client LEFT JOIN buy USING (who) GROUP BY ALL) CROSS JOIN today""",
}


def q(body: str) -> str:
    """The statement with the facts it uses, directly or through others, in front."""
    import re

    def uses(text: str) -> list[str]:
        return [name for name in PARTS if re.search(rf"\b{name}\b", text)]

    needed, todo = set(), uses(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += uses(PARTS[name])
    parts = ", ".join(f"{name} AS ({sql})" for name, sql in PARTS.items() if name in needed)
    return f"WITH {parts} {body}" if parts else body


def pick(source: str, where: str = "", group: str = "", **columns: str) -> str:
    """SELECT named expressions FROM source."""
    what = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return q(f"SELECT {what} FROM {source}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {group}" if group else ""))


SQL: dict[str, str] = {}

# ------------------------------------------------------------------ tables and marts

MEDIUM, AD = {"channel_id": n("medium_id"), "channel_name": "title"}, {"campaign_id": n("ad_id"), "campaign_name": "ad_title"}
SQL["source_channels"] = pick("medium", **MEDIUM)
SQL["source_campaigns"] = pick("ad", **AD, channel_id=n("medium_id"), start_date=day("opens"), end_date=day("closes"), objective="goal")
SQL["source_daily_campaign_spend"] = pick("outlay", campaign_id=n("ad_id"), spend_date=day("on_day"), spend_amount=hundredths("c"),
                                          impressions="shown", clicks="clicked")
SQL["source_customers"] = pick("client", customer_id="who", first_campaign_id=n("ad_id"), signup_date=day("joined"), region="area")
SQL["source_leads"] = pick("contact", lead_id="contact_id", campaign_id=n("ad_id"), lead_date=day("on_day"), converted_flag="won",
                           converted_customer_id="who")
SQL["source_orders"] = pick("buy", order_id="buy_id", customer_id="who", order_date=day("on_day"), order_amount=hundredths("c"))
SQL["stg_campaigns"] = pick("placed", **AD, **MEDIUM, start_date=day("opens"), end_date=day("closes"), objective="goal",
                            campaign_duration_days=n("closes - opens"))
SQL["stg_customers"] = pick("person", customer_id="who", first_campaign_id=n("ad_id"), acquisition_channel_id=n("medium_id"),
                            acquisition_channel_name="title", signup_date=day("joined"), region="area")
SQL["mart_campaign_spend"] = pick("effort", "spent IS NOT NULL", campaign_id=n("ad_id"), total_spend=hundredths("spent"),
                                  total_impressions=n("shown"), total_clicks=n("clicked"), first_spend_date=day("since"), last_spend_date=day("until"))
FUNNEL = {"lead_count": n("leads"), "converted_lead_count": n("wins"), "acquired_customer_count": n("gained")}
SQL["mart_campaign_funnel"] = pick("effort", "leads IS NOT NULL", campaign_id=n("ad_id"), **FUNNEL)
SQL["mart_campaign_revenue"] = pick("effort", "people IS NOT NULL", campaign_id=n("ad_id"), channel_id=n("medium_id"),
                                    revenue_in_campaign_window=hundredths("run"), revenue_lifetime_to_date=hundredths("life"))
BUYER = {"customer_id": "who", "signup_date": day("joined"), "order_count": "n_ids"}
SPAN = {"first_order_date": day("first_at"), "last_order_date": day("last_at")}
SQL["mart_customer_revenue"] = pick(
    "person", **BUYER, **SPAN, first_campaign_id=n("ad_id"), acquisition_channel_id=n("medium_id"), acquisition_channel_name="title",
    region="area", lifetime_revenue_to_date=hundredths("c0"))
SQL["mart_reference_date"] = pick("today", reference_date=day("t"), reference_month=day(month("t")))
_SPINE = (f"(SELECT *, {month('joined')} AS cohort, CAST({month('joined')} + to_months(CAST(age AS INTEGER)) AS DATE) AS now "
          "FROM person JOIN ages ON age <= on_file) grown")
SPINE = {"customer_id": "grown.who", "cohort_month": day("grown.cohort"), "channel_id": n("grown.medium_id"),
         "channel_name": "grown.title", "activity_month": day("now"), "months_since_acquisition": n("grown.age")}
SQL["mart_customer_cohort_spine"] = pick(_SPINE, **SPINE)
SQL["mart_customer_month_activity"] = pick(
    f"{_SPINE} LEFT JOIN step ON step.who = grown.who AND step.age = grown.age", **SPINE,
    orders_count=n("coalesce(step.n, 0)"), revenue=hundredths("coalesce(step.c, 0)"), is_active="step.who IS NOT NULL")
KEPT = {"months_since_acquisition": n("age"), "customers_in_scope": "people", "active_customers": "active",
        "retention_rate_pct": pct("active", "people")}
SQL["mart_channel_retention"] = pick("kept", **MEDIUM, **KEPT)
_SEGMENT_RULES = [("Champions", "least(r, f, m) >= 4"), ("New", "n = 1 AND r >= 4"), ("Lapsed", "greatest(r, f, m) <= 2"),
                  ("At Risk", "r <= 2 AND greatest(f, m) >= 3"), ("Loyal", "least(f, m) >= 3")]
SEGMENT = "CASE " + " ".join(f"WHEN {rule} THEN '{label}'" for label, rule in _SEGMENT_RULES) + " ELSE 'Needs Attention' END"
RFM = {"recency_days": n("idle"), "frequency": "n", "monetary": hundredths("c_all"), "recency_score": "r", "frequency_score": "f",
       "monetary_score": "m", "segment": SEGMENT}
SQL["mart_customer_rfm"] = pick("scored", customer_id="who", **MEDIUM, signup_date=day("joined"), **RFM)
SQL["mart_ltv_90d"] = pick("person", customer_id="who", first_campaign_id=n("ad_id"), **MEDIUM, signup_date=day("joined"),
                           ltv_90d=hundredths("c_90"), window_complete="past_90")

# ------------------------------------------------------------------ campaign and channel metrics

SPENT, LEADS, PEOPLE = "spent IS NOT NULL", "leads IS NOT NULL", "people IS NOT NULL"
ALL = f"{SPENT} AND {LEADS} AND {PEOPLE}"
RATE, CAC = pct("wins", "leads"), each("spent", "gained")
ROAS, ROAS_RUN = ratio("life", "spent"), ratio("run", "spent")
CONTRIBUTION = hundredths("life - spent")
by_rank = lambda value: f"RANK() OVER (PARTITION BY title ORDER BY {value} DESC NULLS FIRST)"
over_channels = lambda where: f"(SELECT title, sum(spent) AS spent, sum(leads) AS leads, sum(wins) AS wins, sum(gained) AS gained, " \
    f"sum(run) AS run, sum(life) AS life FROM effort WHERE {where} GROUP BY title)"  # noqa: E731
CH = {"channel_name": "title"}
SQL["funnel_by_campaign"] = pick("effort", LEADS, **AD, **CH, **FUNNEL, conversion_rate_pct=RATE, conv_rate_rank_in_channel=by_rank(RATE))
SQL["funnel_by_channel"] = pick(over_channels(LEADS), **CH, **FUNNEL, conversion_rate_pct=RATE)
SQL["funnel_totals"] = pick("(SELECT sum(leads) AS leads, sum(wins) AS wins, sum(gained) AS gained FROM effort)", total_leads=n("leads"),
                            total_conversions=n("wins"), overall_conversion_rate_pct=RATE, total_customers_acquired=n("gained"))
COST = {"total_spend": hundredths("spent"), "acquired_customer_count": n("gained"), "cac": CAC}
SQL["cac_by_campaign"] = pick("effort", f"{SPENT} AND {LEADS}", **AD, **CH, **COST)
SQL["cac_by_channel"] = pick(over_channels(f"{SPENT} AND {LEADS}"), **CH, **COST)
PERFORMANCE = FUNNEL | COST | {"conversion_rate_pct": RATE, "revenue_lifetime_to_date": hundredths("life"), "roas_lifetime": ROAS}
SQL["performance_by_campaign"] = pick("effort", ALL, **AD, **CH, objective="goal", **PERFORMANCE)
SQL["performance_by_channel"] = pick("reach", **CH, **PERFORMANCE)
GAIN = {"total_spend": hundredths("spent"), "revenue_lifetime_to_date": hundredths("life"), "marketing_contribution": CONTRIBUTION}
SQL["contribution_by_campaign"] = pick("effort", f"{SPENT} AND {PEOPLE}", **AD, **CH, **GAIN, contribution_rank_in_channel=by_rank("life - spent"))
SQL["contribution_by_channel"] = pick(over_channels(f"{SPENT} AND {PEOPLE}"), **CH, **GAIN)
RETURNS = {"total_spend": hundredths("spent"), "revenue_in_campaign_window": hundredths("run"), "revenue_lifetime_to_date": hundredths("life"),
           "roas_in_window": ROAS_RUN, "roas_lifetime": ROAS}
SQL["roas_by_campaign"] = pick("effort", f"{SPENT} AND {PEOPLE}", **AD, **CH, **RETURNS)
SQL["roas_by_channel"] = pick(over_channels(f"{SPENT} AND {PEOPLE}"), **CH, **RETURNS)

# Lifetime value against acquisition cost. "v" holds rounded cents: cost, value, value of 90 days.
_V_AD = (f"(SELECT *, {near('spent', 'gained')} AS cost, {near('life', 'people')} AS value, {near('s90', 'n90')} AS early "
         f"FROM effort WHERE {{where}}) v")
_V_CH = (f"(SELECT reach.*, {near('reach.spent', 'reach.gained')} AS cost, {near('worth.life', 'worth.people')} AS value, "
         f"{near('s90', 'n90')} AS early FROM reach JOIN worth USING (title)) v")
_V_COST = (f"(SELECT a.*, {near('a.spent', 'a.gained')} AS cost, {near('worth.life', 'worth.people')} AS value, "
           f"{near('s90', 'n90')} AS early FROM {over_channels(f'{SPENT} AND {LEADS}')} a JOIN worth USING (title)) v")
VALUE = {"cac": hundredths("cost"), "avg_ltv_lifetime": hundredths("value"), "ltv_cac_lifetime": ratio("value", "cost"),
         "avg_ltv_90d": hundredths("early"), "ltv_cac_90d": ratio("early", "cost"), "total_spend": hundredths("spent")}
SQL["ltv_cac_by_channel"] = pick(_V_COST, **CH, **VALUE, customers_acquired=n("gained"), heuristic_flag_lifetime="""
  CASE WHEN cost <> 0 AND value >= 3 * cost THEN 'Above 3x heuristic' WHEN cost <> 0 AND value >= cost
  THEN 'Positive but below 3x heuristic' ELSE 'Below 1x (spend exceeds observed lifetime value)' END""")
SQL["ltv_cac_by_campaign"] = pick(_V_AD.format(where=ALL), **AD, **CH, **VALUE, acquired_customer_count=n("gained"))
PROFIT = PERFORMANCE | {"avg_ltv_lifetime": hundredths("value"), "marketing_contribution": CONTRIBUTION,
                        "ltv_cac_lifetime": f"CASE WHEN gained <> 0 THEN {ratio('value * gained', 'spent')} END"}
SQL["profitability_by_campaign"] = pick(_V_AD.format(where=ALL), **AD, **CH, **PROFIT, revenue_in_campaign_window=hundredths("run"), roas_in_window=ROAS_RUN)
SQL["profitability_by_channel"] = pick(_V_CH, **CH, **PROFIT)
SHORT = {"leads": n("leads"), "conversions": n("wins"), "customers_acquired": n("gained"), "total_spend": hundredths("spent"),
         "conversion_rate_pct": RATE, "cac": CAC, "revenue_lifetime": hundredths("life"), "roas_lifetime": ROAS,
         "avg_ltv_lifetime": hundredths("value"), "marketing_contribution": CONTRIBUTION}
SQL["pbi_campaign_performance"] = pick(_V_AD.format(where=ALL), **CH, **AD, **SHORT, objective="goal", start_date=day("opens"),
                                       end_date=day("closes"), ltv_cac_lifetime=PROFIT["ltv_cac_lifetime"])
_KEPT_AT = lambda age: f"(SELECT {pct('active', 'people')} FROM kept WHERE kept.title = v.title AND age = {age})"
_MEAN = f"(SELECT {near('sum(spent)', 'sum(gained)')} FROM reach)"
# Labels and rationales, best first; a rule is (least value : cost, cost at most the mean).
ADVICE = [("Scale candidate", "Contribution positive, LTV:CAC >= 3x heuristic, CAC at or below dataset average"),
          ("Maintain / monitor", "Contribution positive, LTV:CAC >= 1.5x - healthy but not exceptional"),
          ("Review", "Contribution positive but LTV:CAC below 1.5x, or CAC well above average"),
          ("Reduce / investigate", "Contribution negative or LTV:CAC below 1x - spend is not being recovered")]
_PLACE = f"""CASE WHEN life <= spent THEN 4 WHEN {near('100 * value', 'cost')} >= 300 AND {near(f'100 * cost', _MEAN)} <= 100 THEN 1
  WHEN {near('100 * value', 'cost')} >= 150 THEN 2 WHEN {near('100 * value', 'cost')} >= 100 THEN 3 ELSE 4 END"""
_advice = lambda place, part: "([" + ", ".join(f"'{a[part]}'" for a in ADVICE) + f"])[{place}]"
SQL["budget_allocation"] = pick(
    _V_CH, **CH, total_spend=hundredths("spent"), customers_acquired=n("gained"), cac=hundredths("cost"), cac_vs_avg_ratio=ratio("cost", _MEAN),
    roas_lifetime=ROAS, ltv_cac_lifetime=ratio("value", "cost"), marketing_contribution=CONTRIBUTION, retention_month_3_pct=_KEPT_AT(3),
    recommendation=_advice(_PLACE, 0), rationale=_advice(_PLACE, 1))
_EXACT = f"""CASE WHEN life <= spent OR cost = 0 OR cost IS NULL THEN 4 WHEN value >= 3 * cost AND cost <= {_MEAN} THEN 1
  WHEN 2 * value >= 3 * cost THEN 2 WHEN value >= cost THEN 3 ELSE 4 END"""
SQL["pbi_channel_performance"] = pick(
    _V_CH, **CH, **SHORT, revenue_in_window=hundredths("run"), roas_in_window=ROAS_RUN, avg_ltv_90d=hundredths("early"),
    ltv_cac_lifetime=ratio("value", "cost"), ltv_cac_90d=ratio("early", "cost"), retention_month_1_pct=_KEPT_AT(1),
    retention_month_3_pct=_KEPT_AT(3), recommendation=_advice(_EXACT, 0))

# ------------------------------------------------------------------ cohorts and customers

CELL = {"cohort_month": day("cohort"), "months_since_acquisition": n("age"), "cohort_size": "size"}
SQL["pbi_cohort_retention"] = pick("cell", **CELL, active_customers="active", retention_rate_pct=pct("active", "size"))
SQL["cohort_retention"] = pick("cell", **CELL, active_customers="active", retention_rate_pct=pct("active", "size"), monthly_revenue=hundredths("c"),
                               cumulative_revenue=hundredths("c_so_far"), cumulative_ltv_per_customer=each("c_so_far", "size"))
SQL["cohort_ltv_checkpoints"] = pick("cell", "age IN (0, 1, 3, 6)", **CELL, cumulative_ltv_per_customer=each("c_so_far", "size"))
SQL["retention_matrix"] = pick("cell", group="cohort", cohort_month=day("cohort"), retention_by_month=f"string_agg(printf('%.2f', {pct('active', 'size')}), ',' ORDER BY age)")
SQL["retention_matrix_by_year"] = pick("cell", group="cohort, age // 12", cohort_month=day("cohort"), from_month="CAST(age // 12 * 12 AS BIGINT)",
                                       **{f"plus_{k}": f"max(CASE WHEN age % 12 = {k} THEN {pct('active', 'size')} END)" for k in range(12)})
SQL["channel_retention_grid"] = pick("kept", **CH, **KEPT)
SQL["channel_retention_checkpoints"] = pick("kept", "age IN (0, 1, 3, 6)", **CH, **KEPT)
SQL["customer_revenue_ranked"] = pick("person", **BUYER, **SPAN, acquisition_channel_name="title", lifetime_revenue_to_date=hundredths("c0"),
                                      revenue_rank_in_channel=by_rank("c0"))
SQL["customer_revenue_by_channel"] = pick("worth", acquisition_channel_name="title", customers_acquired="people",
                                          avg_orders_per_customer=ratio("n_ids", "people"), avg_revenue_per_customer=each("life", "people"),
                                          total_revenue_to_date=hundredths("life"))
SQL["ltv_by_customer"] = pick("person", **BUYER, acquisition_channel_name="title", lifetime_ltv=hundredths("c0"))
SQL["ltv_by_channel"] = pick("person", group="title", acquisition_channel_name="title", customers="count(*)", avg_lifetime_ltv=each("sum(c0)", "count(*)"),
                             median_lifetime_ltv="floor(quantile_cont(c0, 0.5) + 0.5) / 100")
SQL["ltv_by_campaign"] = pick("effort", PEOPLE, **AD, **CH, customers="people", avg_lifetime_ltv=each("life", "people"))
SQL["ltv_90d_by_channel"] = pick("worth", **CH, customers_with_complete_window="n90", excluded_incomplete_window="rest", avg_ltv_90d=each("s90", "n90"))
_BY_SEGMENT = f"(SELECT {SEGMENT} AS kind, count(*) AS people, sum(idle) AS idle, sum(n) AS n, sum(c_all) AS c FROM scored GROUP BY 1)"
SQL["rfm_segment_summary"] = SQL["pbi_rfm_segments"] = pick(
    _BY_SEGMENT, segment="kind", customers="people", pct_of_customers=pct("people", "sum(people) OVER ()"),
    avg_recency_days=f"CAST({near('10 * idle', 'people')} AS DOUBLE) / 10", avg_frequency=ratio("n", "people"), avg_monetary=each("c", "people"),
    segment_revenue=hundredths("c"), pct_of_revenue=pct("c", "sum(c) OVER ()"))
SQL["rfm_segment_by_channel"] = pick("scored", group="1, 2", channel_name="title", segment=SEGMENT, customers="count(*)")
SQL["rfm_sample"] = pick(f"(SELECT * FROM (SELECT *, {SEGMENT} AS kind FROM scored) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY who) <= 3)",
                         customer_id="who", **CH, **(RFM | {"segment": "kind"}))

# ------------------------------------------------------------------ exports and dashboard

_TOTALS = """(SELECT (SELECT sum(spent) FROM effort) AS spent, (SELECT sum(life) FROM effort) AS life, (SELECT sum(gained) FROM effort) AS gained,
  (SELECT sum(c0) FROM person) AS worth_c, (SELECT count(*) FROM person) AS people, (SELECT count(*) FROM client) AS clients, (SELECT t FROM today) AS t)"""
SQL["pbi_executive_summary"] = pick(_TOTALS, total_spend=hundredths("spent"), total_revenue=hundredths("life"), roas_lifetime=ROAS, blended_cac=CAC,
                                    avg_ltv_lifetime=each("worth_c", "people"), marketing_contribution=CONTRIBUTION, total_customers="clients",
                                    data_as_of=day("t"))
SQL["pbi_monthly_trend"] = pick("(SELECT on_day, c AS out_c, 0 AS in_c FROM outlay UNION ALL SELECT on_day, 0, c FROM buy)", group=month("on_day"),
                                month=day(month("on_day")), total_spend=hundredths("sum(out_c)"), total_revenue=hundredths("sum(in_c)"))
SQL["kpi_totals"] = pick(_TOTALS, total_revenue=hundredths("life"), total_spend=hundredths("spent"), marketing_contribution=CONTRIBUTION)
_BLEND = {"blended_cac": f"{hundredths('sum(reach.spent)')} / nullif(CAST(sum(reach.gained) AS DOUBLE), 0)",
          "blended_roas_lifetime": f"{hundredths('sum(reach.life)')} / nullif({hundredths('sum(reach.spent)')}, 0)"}
SQL["blended_measures"] = pick("reach JOIN worth USING (title)", **_BLEND)
SQL["blended_measures_paid"] = pick("reach JOIN worth USING (title)", "title IN ('AMERICA', 'ASIA', 'Paid Search', 'Paid Social')", **_BLEND)


def columns_of(name: str, *columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM ({SQL[name]}) whole"


SQL["page_channel_table"] = columns_of("pbi_channel_performance", "channel_name", "total_spend", "conversion_rate_pct", "cac", "revenue_lifetime", "roas_lifetime",
                                       "avg_ltv_lifetime", "ltv_cac_lifetime", "marketing_contribution", "recommendation")
SQL["page_channel_scatter"] = columns_of("pbi_channel_performance", "channel_name", "cac", "avg_ltv_lifetime", "customers_acquired")
SQL["page_campaign_table"] = columns_of("pbi_campaign_performance", "channel_name", "campaign_name", "total_spend", "cac", "roas_lifetime", "ltv_cac_lifetime",
                                        "marketing_contribution")

# ------------------------------------------------------------------ check suites


def repeated(source: str, *key: str) -> str:
    return f"(SELECT count(*) - count(DISTINCT {key[0] if len(key) == 1 else '(' + ', '.join(key) + ')'}) FROM {source})"


def bad(source: str, rule: str) -> str:
    return f"(SELECT count_if({rule}) FROM {source})"


def missing(source: str, *fields: str) -> str:
    return bad(source, " OR ".join(f"{f} IS NULL" for f in fields))


def lost(source: str, key: str, parent: str, parent_key: str) -> str:
    return f"(SELECT count(*) FROM {source} WHERE NOT EXISTS (SELECT 1 FROM {parent} up WHERE up.{parent_key} = {source}.{key}))"


def gap(left: str, right: str) -> str:
    """Absolute difference of two 'expression FROM source' totals."""
    return f"abs((SELECT {left}) - (SELECT {right}))"


def money(x: str) -> str:
    return f"({x}) / 100.0"


def suite(checks: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST({value} AS DOUBLE) AS failing_rows" for name, value in checks)
    return q(f"SELECT *, CASE WHEN failing_rows = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({rows})")


LIFE = "sum(c0) FROM person"
SQL["data_quality_checks"] = suite([
    # The check names, here and below.
    *((f"PK uniqueness: {label}", repeated(source, key)) for label, source, key in (
        ("channels", "medium", "medium_id"), ("campaigns", "ad", "ad_id"), ("customers", "client", "who"), ("leads", "contact", "contact_id"),
        ("orders", "buy", "buy_id"))),
    ("Required fields: campaigns (channel_id/dates)", missing("ad", "medium_id", "opens", "closes")),
    ("Required fields: customers (first_campaign_id/signup_date)", missing("client", "ad_id", "joined")),
    ("Required fields: orders (customer_id/order_date/order_amount)", missing("buy", "who", "on_day", "c")),
    ("Orphans: campaigns.channel_id -> channels", lost("ad", "medium_id", "medium", "medium_id")),
    ("Orphans: customers.first_campaign_id -> campaigns", lost("client", "ad_id", "ad", "ad_id")),
    ("Orphans: leads.campaign_id -> campaigns", lost("contact", "ad_id", "ad", "ad_id")),
    ("Orphans: orders.customer_id -> customers", lost("buy", "who", "client", "who")),
    ("Non-negative spend", bad("outlay", "c < 0")),
    ("Positive order amounts", bad("buy", "c <= 0")),
    ("Campaign dates: end >= start", bad("ad", "closes < opens")),
    ("Spend dates within campaign window", bad("outlay JOIN ad USING (ad_id)", "on_day NOT BETWEEN opens AND closes")),
    ("Lead conversion flag consistency", bad("contact", "won = (who IS NULL)")),
    ("Converted leads map to exactly one customer each (no duplicate customer reuse)",
     bad("(SELECT count(*) AS times FROM contact WHERE who IS NOT NULL GROUP BY who)", "times > 1")),
    ("Converted lead campaign matches customer first_campaign_id", bad("contact JOIN client USING (who)", "won AND contact.ad_id <> client.ad_id")),
    ("Converted lead date matches customer signup_date", bad("contact JOIN client USING (who)", "won AND on_day <> joined")),
    ("Order date >= customer signup_date", bad("buy JOIN client USING (who)", "on_day < joined")),
    ("Reconciliation: campaign-level leads sum = table total", gap("sum(leads) FROM effort", "count(*) FROM contact")),
    ("Reconciliation: campaign-level acquired customers sum = customers table total", gap("sum(gained) FROM effort", "count(*) FROM client")),
    ("Reconciliation: campaign-level spend sum = daily_campaign_spend total", money(gap("sum(spent) FROM effort", "sum(c) FROM outlay"))),
    ("Reconciliation: customer-level revenue sum = orders total", money(gap(LIFE, "sum(c) FROM buy"))),
])
SQL["analytics_checks"] = suite([
    ("Cohort: every customer maps to exactly one cohort_month",
     bad(f"(SELECT count(DISTINCT {month('joined')}) AS times FROM person WHERE on_file >= 0 GROUP BY who)", "times <> 1")),
    ("Cohort: retention_rate_pct never exceeds 100", bad("kept", "active > people")),
    ("Cohort: sum of cohort sizes = total customers", gap("sum(size) FROM cohorts", "count(*) FROM client")),
    ("RFM: every customer appears exactly once", bad("(SELECT count(*) AS times FROM scored GROUP BY who)", "times > 1")),
    ("RFM: no null recency/frequency/monetary values", missing("scored", "idle", "n", "c_all")),
    ("RFM: segment counts sum to total customers", gap("count(*) FROM scored", "count(*) FROM client")),
    ("LTV: sum of customer lifetime LTV = sum of order revenue", money(gap(LIFE, "sum(c) FROM buy"))),
    ("LTV: channel-level revenue (customer mart) = channel-level revenue (campaign mart)", money(
        "(SELECT coalesce(sum(abs(both_c)), 0) FROM (SELECT title, sum(c) AS both_c FROM (SELECT title, c0 AS c FROM person "
        "UNION ALL SELECT title, -life FROM effort WHERE life IS NOT NULL) GROUP BY title))")),
    ("LTV:CAC: total customers across channels = total customers table", gap("sum(gained) FROM effort", "count(*) FROM client")),
    ("Profitability: total revenue_lifetime reconciles with Phase 2 mart", money(gap("sum(life) FROM effort", LIFE))),
    ("Profitability: total spend reconciles with Phase 2 mart", money(gap("sum(spent) FROM effort", "sum(c) FROM outlay"))),
])
SQL["constraint_checks"] = suite([
    ("UNIQUE: channels.channel_name", repeated("medium", "title")),
    ("NOT NULL: channels", missing("medium", "medium_id", "title")),
    ("NOT NULL: campaigns (campaign_id/campaign_name/objective)", missing("ad", "ad_id", "ad_title", "goal")),
    ("PK uniqueness: daily_campaign_spend (campaign_id, spend_date)", repeated("outlay", "ad_id", "on_day")),
    ("Non-negative impressions", bad("outlay", "shown < 0")),
    ("Non-negative clicks", bad("outlay", "clicked < 0")),
    ("NOT NULL: daily_campaign_spend", missing("outlay", "ad_id", "on_day", "c", "shown", "clicked")),
    ("NOT NULL: leads (lead_id/campaign_id/lead_date/converted_flag)", missing("contact", "contact_id", "ad_id", "on_day", "won")),
    ("NOT NULL: customers.customer_id", missing("client", "who")),
    ("NOT NULL: orders.order_id", missing("buy", "buy_id")),
    ("Orphans: daily_campaign_spend.campaign_id -> campaigns", lost("outlay", "ad_id", "ad", "ad_id")),
    ("Orphans: leads.converted_customer_id -> customers",
     "(SELECT count(*) FROM contact WHERE who IS NOT NULL AND who NOT IN (SELECT who FROM client))"),
])
SQL["month0_retention_info"] = pick("kept", "age = 0", info="'Month 0 retention (all cohorts, weighted)'", pct=pct("sum(active)", "sum(people)"))
SQL["zero_customer_campaigns"] = pick("effort", f"{SPENT} AND gained = 0", campaign_name="ad_title", acquired_customer_count="gained", cac=CAC)

# ------------------------------------------------------------------ legacy reports

UNITS = lambda cents: f"CAST({near(cents, '100')} AS DOUBLE)"


def tier(value: str, *bounds: int) -> str:
    """The loyalty label of a value by three upper bounds."""
    labels = ("Loyal Client", "High Potential Client", "Passive Client")
    return "CASE " + " ".join(f"WHEN {value} <= {b} THEN '{label}'" for b, label in zip(bounds, labels, strict=True)) + " ELSE 'At Risk' END"


RISK = "CAST(risk AS DOUBLE) / 10000"
SQL["legacy_users"] = pick("client_score", user_id="who", signup_date=day("joined"), churn_probability=RISK)
SQL["legacy_campaigns"] = pick("placed", campaign_id=n("ad_id"), channel="title")
SQL["legacy_conversions"] = pick("effort", LEADS, campaign_id=n("ad_id"), conversions=n("wins"))
SQL["legacy_daily_spend"] = pick("outlay JOIN placed USING (ad_id)", campaign_id=n("ad_id"), channel="title", spend=hundredths("c"))
SQL["legacy_revenue"] = pick("buy", user_id="who", revenue=hundredths("c"))
SQL["legacy_user_acquisition"] = pick("client", user_id="who", campaign_id=n("ad_id"))
SQL["legacy_ltv_per_user"] = pick("buy", group="who", user_id="who", lifetime_value=UNITS("sum(c)"))
SQL["legacy_top_value_user"] = pick("buy", group="who", user_id="who", lifetime_value=UNITS("sum(c)")) + " ORDER BY lifetime_value DESC, user_id LIMIT 1"
SQL["legacy_top_converting_channel"] = pick("effort", LEADS, group="title", channel="title", total_conversions=n("sum(wins)")) + \
    " ORDER BY total_conversions DESC, channel LIMIT 1"
SQL["legacy_loyalty_tiers"] = pick(f"(SELECT *, {near('risk', '10')} AS tenths FROM client_score)", user_id="who", signup_date=day("joined"),
                                   churn_prob_perc="CAST(tenths AS DOUBLE) / 10", client_loyalty=tier("tenths", 100, 300, 600))
SQL["legacy_user_revenue_tiers"] = pick("client_score JOIN buy USING (who)", user_id="who", lifetime_value=UNITS("sum(c) OVER (PARTITION BY who)"),
                                        churn_probability=RISK, client_loyalty=tier("risk", 1000, 3000, 6000))
SQL["legacy_churn_buckets"] = pick("(SELECT risk // 1000 AS tenth, c FROM client_score JOIN buy USING (who))", group="tenth",
                                   churn_bucket="CAST(tenth AS DOUBLE) / 10", avg_income=f"CAST({near('sum(c)', '100 * count(*)')} AS DOUBLE)",
                                   client_loyalty=tier("tenth", 1, 3, 6))
SQL["legacy_channel_profit"] = pick(
    f"(SELECT title, {near('sum(c0)', '100')} AS earned FROM person WHERE n > 0 GROUP BY title) JOIN "
    f"(SELECT title, {near('sum(c)', '100')} AS paid FROM outlay JOIN placed USING (ad_id) GROUP BY title) USING (title)",
    channel="title", total_revenue="CAST(earned AS DOUBLE)", total_spend="CAST(paid AS DOUBLE)", profit="CAST(earned - paid AS DOUBLE)", roas=ratio("earned", "paid"))
SQL["legacy_cac"] = pick(f"(SELECT ad_id, title, {near('spent', '100')} AS paid, people FROM effort WHERE {SPENT} AND {PEOPLE})", channel="title",
                         campaign_id=n("ad_id"), total_spend="CAST(paid AS DOUBLE)", total_clients="people", cac=ratio("paid", "people"))
SQL["legacy_row_counts"] = q(" UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}" for name, source in (
    ("campaigns", "placed"), ("conversions", "effort WHERE leads IS NOT NULL"), ("daily_spend", "outlay JOIN placed USING (ad_id)"),
    ("revenue", "buy"), ("users", "client"))))
