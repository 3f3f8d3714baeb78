"""The same queries as SQL for an independent engine: name and SQL on the given tables."""
from __future__ import annotations

SQL: dict[str, str] = {}

# --- shared tables -------------------------------------------------------------------------

HIST = """hist AS (
  SELECT id, lead_id, lag(to_status) OVER (PARTITION BY lead_id ORDER BY \"at\", id) AS from_status, to_status, \"at\" FROM (
    SELECT event_id AS id, CAST(user_id * 100 + day(ts) AS BIGINT) AS lead_id, ts AS \"at\",
      CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'contacted' WHEN 'click' THEN 'meeting'
        WHEN 'purchase' THEN 'won' ELSE 'lost' END AS to_status FROM events))"""
FLEADS = """fleads AS (
  SELECT lead_id AS id, last(to_status ORDER BY \"at\", id) AS status, min(\"at\") AS created_at
  FROM hist GROUP BY lead_id HAVING bool_or(to_status = 'new'))"""
KNOWN = "known AS (SELECT * FROM hist WHERE lead_id IN (SELECT id FROM fleads))"
STAGES = "stages(pos, stage) AS (VALUES (0,'new'),(1,'contacted'),(2,'meeting'),(3,'proposal'),(4,'negotiation'),(5,'won'))"
SIGNAL = "CASE WHEN {n} >= 5 THEN 'High' WHEN {n} >= 2 THEN 'Medium' WHEN {n} = 1 THEN 'Low' ELSE 'None' END"
SCANS = f"""scans0 AS (
  SELECT 'u' || user_id || '.example.com' AS domain, CAST(ts AS DATE) AS scanned_at, user_id * 100000000 + CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS id,
    count(*) FILTER (event_type <> 'error') AS it_jobs, count(*) FILTER (event_type = 'signup') AS contacts,
    bool_or(event_type = 'click') AS has_email, bool_or(event_type = 'purchase') AS has_phone
  FROM events GROUP BY ALL), scans AS (SELECT *, {SIGNAL.format(n='it_jobs')} AS it_hiring FROM scans0)"""
COMPANIES = """companies AS (
  SELECT min(id) OVER (PARTITION BY domain) AS id, domain, upper(domain[1]) || split_part(domain, '.', 1)[2:] AS name,
    CASE WHEN has_phone THEN '02-' || id END AS phone, CASE WHEN has_email THEN 'info@' || domain END AS email,
    'https://' || domain AS website, it_hiring, it_jobs, contacts,
    min(scanned_at) OVER (PARTITION BY domain) AS created_at, scanned_at AS updated_at
  FROM scans QUALIFY row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, scans.id DESC) = 1)"""
TREND = """trend AS (
  SELECT c.*, p.it_jobs AS prev_it_jobs, p.scanned_at AS prev_scanned_at, c.it_jobs - p.it_jobs AS jobs_delta
  FROM companies c LEFT JOIN (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, id DESC) = 2) p
  USING (domain))"""
WITH_HIST = f"WITH {HIST}, {FLEADS}, {KNOWN}, {STAGES} "
WITH_TREND = f"WITH {SCANS}, {COMPANIES}, {TREND} "
EVENTS_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

CONTRACTS = """contracts AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, c_name AS company_name,
    CASE WHEN c_nationkey < 13 THEN replace(lower(c_name), '#', '-') || '.co.kr' END AS domain,
    coalesce(CASE WHEN c_nationkey < 13 THEN replace(lower(c_name), '#', '-') || '.co.kr' END, lower(c_name)) AS customer_key,
    CASE WHEN d > 2 THEN lpad(o_custkey::VARCHAR, 10, '0') END AS biz_number, 'PO-' || o_orderkey AS title,
    ['dispatch','contract','si','sm','odc'][d] AS project_type,
    CASE WHEN o_orderstatus = 'F' AND d = 5 THEN 'terminated' WHEN o_orderstatus = 'F' THEN 'completed'
      WHEN o_orderstatus = 'O' THEN 'active' ELSE 'renewed' END AS status,
    o_orderdate::DATE AS start_date, o_orderdate::DATE + 365 AS end_date, o_orderdate::DATE AS signed_date,
    CAST(floor(o_totalprice) AS BIGINT) * [10, 400, 20, 60][c_custkey % 4 + 1] AS amount, team AS team_size,
    CAST(d AS BIGINT) AS satisfaction, CAST(d * 30 AS BIGINT) AS renewal_notice_days,
    [upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), o_orderpriority[3:]] AS tech,
    CASE WHEN d = 1 THEN 'urgent memo' END AS memo
  FROM (SELECT *, CAST(o_orderpriority[1] AS INT) AS d FROM orders) o JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS team FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
FLAGS = """flags AS (SELECT *, date_diff('day', DATE '2001-09-01', end_date) AS days_left,
    status = 'active' AND date_diff('day', DATE '2001-09-01', end_date) <= renewal_notice_days AS expiring,
    status = 'active' AND end_date < DATE '2001-09-01' AS overdue_end FROM contracts)"""
GRADE = """CASE WHEN {t} >= 500000000 AND {n} >= 1 THEN 'S' WHEN {t} >= 200000000 AND {n} >= 3 THEN 'S'
    WHEN {t} >= 200000000 AND {n} >= 1 THEN 'A' WHEN {t} >= 50000000 AND {n} >= 2 THEN 'A'
    WHEN {t} >= 50000000 AND {n} >= 1 THEN 'B' ELSE 'C' END"""
NEWEST = "start_date DESC, end_date DESC, id DESC"
CUSTOMERS = f"""roll AS (SELECT customer_key,
    CAST(coalesce(sum(amount) FILTER (status <> 'terminated'), 0) AS BIGINT) AS total_value,
    CAST(coalesce(sum(amount) FILTER (status = 'active'), 0) AS BIGINT) AS active_value, count(*) AS contract_count,
    count(*) FILTER (status <> 'terminated') AS live_count, count(*) FILTER (status = 'active') AS active_count,
    count(*) FILTER (status = 'renewed') AS renewed_count, count(*) FILTER (expiring) AS expiring_count,
    min(signed_date) AS first_signed, max(end_date) AS last_end, min(end_date) FILTER (status = 'active') AS next_end,
    round_even(avg(satisfaction), 1) AS satisfaction, array_to_string(list_sort(list(DISTINCT project_type)), '|') AS project_types,
    first(biz_number ORDER BY {NEWEST}) FILTER (biz_number IS NOT NULL) AS biz_number,
    first(company_id ORDER BY {NEWEST}) FILTER (company_id <> 0) AS company_id,
    first(company_name ORDER BY {NEWEST}) AS company_name, first(domain ORDER BY {NEWEST}) AS domain,
    first(project_type ORDER BY {NEWEST}) AS latest_project_type, first(amount ORDER BY {NEWEST}) AS latest_amount,
    first(team_size ORDER BY {NEWEST}) AS latest_team_size
  FROM flags GROUP BY 1),
terms AS (SELECT customer_key, array_to_string(list_sort(list(DISTINCT t)), '|') AS tech
  FROM (SELECT customer_key, unnest(tech) AS t FROM contracts) GROUP BY 1),
customers AS (SELECT *, {GRADE.format(t='total_value', n='live_count')} AS grade,
  CASE WHEN active_count = 0 THEN date_diff('day', last_end, DATE '2001-09-01') END AS dormant_days FROM roll JOIN terms USING (customer_key))"""
WITH_CONTRACTS = f"WITH {CONTRACTS}, {FLAGS} "
WITH_CUSTOMERS = f"WITH {CONTRACTS}, {FLAGS}, {CUSTOMERS} "

BASE = """base AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, n_name, c_name, c_mktsegment,
    CAST(floor(abs(c_acctbal)) AS BIGINT) AS b, replace(lower(c_name), '#', '-') AS slug,
    lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS tail, DATE '2024-01-01' + CAST(c_custkey % 60 AS INT) AS day
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
BUDGET = "CASE n % 5 WHEN 0 THEN b * 100000000 + 50000000 WHEN 1 THEN b * 1000000 WHEN 2 THEN 250000000 WHEN 4 THEN b * 10000 END"
RAW = f"""rawl AS (SELECT k AS id, CASE WHEN r > 0 THEN slug || '.co.kr' END AS domain, c_name AS company_name,
    CASE WHEN r > 0 THEN 'www.' || slug || '.co.kr/about' END AS website,
    CASE WHEN n > 9 THEN lpad(k::VARCHAR, 10, '0')[1:3] || '-' || lpad(k::VARCHAR, 10, '0')[4:5] || '-' || lpad(k::VARCHAR, 10, '0')[6:10] ELSE 'n/a' END AS biz_number,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS industry, ['enterprise','midsize','sme',NULL,'public'][n % 5 + 1] AS company_size,
    'Agent ' || k AS contact_name, ['cto','director','ceo','other','manager','cio',NULL][k % 7 + 1] AS rank,
    CASE WHEN b % 2 = 0 THEN '02-1234-' || tail END AS phone, CASE WHEN b % 3 = 0 THEN '010-1234-' || tail END AS mobile,
    CASE WHEN b % 5 BETWEEN 1 AND 3 THEN slug || '@mail.co.kr' END AS email, CASE WHEN b % 7 = 0 THEN 'kk' || k END AS kakao,
    ['referral','exhibition','website','coldcall','other'][n % 5 + 1] AS source, ['dispatch','si',NULL][n % 3 + 1] AS project_type,
    [upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), 'Java'] AS tech, CAST({BUDGET} AS BIGINT) AS budget, b % 6 AS team_size,
    CASE WHEN k % 14 BETWEEN 1 AND 12 THEN '2024-' || lpad((k % 14)::VARCHAR, 2, '0') END AS expected_start, CAST(k % 14 AS BIGINT) AS m,
    ['High','Medium','Low',NULL][b % 4 + 1] AS it_hiring,
    ['new','contacted','meeting','proposal','negotiation','won','lost','hold','new'][k % 9 + 1] AS status,
    CASE WHEN k % 9 = 6 THEN ['price','schedule',NULL][n % 3 + 1] END AS lost_reason,
    CASE WHEN n > 3 THEN 'rep ' || r END AS assignee, CASE WHEN b % 3 = 0 THEN 'call back' END AS next_action,
    CASE WHEN b % 4 = 0 THEN day END AS next_date, DATE '2024-01-15' AS last_contact, 'memo ' || n_name AS memo, day AS created_at, b,
    r AS region FROM base)"""
POINTS = """points AS (SELECT *, CASE it_hiring WHEN 'High' THEN 25 WHEN 'Medium' THEN 15 WHEN 'Low' THEN 6 ELSE 0 END AS p_hiring,
    CASE rank WHEN 'cto' THEN 25 WHEN 'cio' THEN 25 WHEN 'ceo' THEN 22 WHEN 'director' THEN 18 WHEN 'manager' THEN 6 WHEN 'other' THEN 4 ELSE 0 END AS p_rank,
    CASE WHEN email IS NOT NULL THEN 10 ELSE 0 END AS p_email, CASE WHEN phone IS NOT NULL OR mobile IS NOT NULL THEN 10 ELSE 0 END AS p_phone,
    CASE WHEN kakao IS NOT NULL THEN 5 ELSE 0 END AS p_kakao,
    CASE WHEN budget >= 300000000 THEN 15 WHEN budget >= 100000000 THEN 12 WHEN budget >= 30000000 THEN 7 WHEN budget > 0 THEN 3 ELSE 0 END AS p_budget,
    CASE source WHEN 'referral' THEN 10 WHEN 'exhibition' THEN 8 WHEN 'website' THEN 8 ELSE 0 END AS p_source,
    CASE WHEN project_type IS NOT NULL THEN 5 ELSE 0 END AS p_project, CASE WHEN biz_number <> 'n/a' THEN 3 ELSE 0 END AS p_biz,
    CASE WHEN expected_start IS NULL THEN 0 WHEN m - 2 <= 3 THEN 8 WHEN m - 2 <= 6 THEN 4 ELSE 0 END AS p_timing,
    CASE WHEN team_size >= 3 THEN 5 ELSE 0 END AS p_team FROM rawl WHERE b % 5 <> 0)"""
P_KEYS = ("hiring", "rank", "email", "phone", "kakao", "budget", "source", "project", "biz", "timing", "team")
LEADS = ("leads AS (SELECT *, CAST(greatest(0, least(100, " + " + ".join(f"p_{k}" for k in P_KEYS) + ")) AS BIGINT) AS score, "
         + "concat_ws(',', " + ", ".join(f"CASE WHEN p_{k} > 0 THEN '{k}=' || p_{k} END" for k in P_KEYS) + ") AS parts FROM points)")
WITH_LEADS = f"WITH {BASE}, {RAW}, {POINTS}, {LEADS} "
OPEN = "status IN ('new','contacted','meeting','proposal','negotiation')"
STATUS_DIM = ("dim(pos, status) AS (VALUES (0,'new'),(1,'contacted'),(2,'meeting'),(3,'proposal'),(4,'negotiation'),(5,'won'),(6,'lost'),(7,'hold'))")

# --- hiring trend --------------------------------------------------------------------------

SQL["upsert_companies"] = WITH_TREND + """SELECT id, domain, name, phone, email, website, it_hiring, it_jobs, contacts,
  created_at::VARCHAR AS created_at, updated_at::VARCHAR AS updated_at FROM companies"""
SQL["append_scan_history"] = WITH_TREND + """SELECT id, domain, scanned_at::VARCHAR AS scanned_at, it_hiring, it_jobs, contacts,
  has_email, has_phone FROM scans"""
SQL["previous_scan"] = WITH_TREND + """SELECT domain, it_jobs, it_hiring, scanned_at::VARCHAR AS scanned_at FROM scans
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY scans.scanned_at DESC, id DESC) = 2"""
SQL["scan_history_top"] = WITH_TREND + """SELECT domain, rn, scanned_at::VARCHAR AS scanned_at, it_hiring, it_jobs, contacts FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY scanned_at DESC, id DESC) AS rn FROM scans) WHERE rn <= 12"""
SQL["company_trend"] = WITH_TREND + "SELECT domain, it_jobs, prev_it_jobs, jobs_delta, prev_scanned_at::VARCHAR AS prev_scanned_at FROM trend"
SQL["rising_companies"] = WITH_TREND + "SELECT domain, it_hiring, it_jobs, jobs_delta FROM trend WHERE jobs_delta > 0"
SQL["trend_label"] = WITH_TREND + """SELECT domain, CASE WHEN jobs_delta IS NULL THEN 'new' WHEN jobs_delta > 0 THEN '▲ +' || jobs_delta
  WHEN jobs_delta < 0 THEN '▼ ' || jobs_delta ELSE '=' END AS trend FROM trend"""
SQL["hiring_signal"] = f"""SELECT domain, it_jobs, {SIGNAL.format(n='it_jobs')} AS it_hiring FROM (
  SELECT user_id || '/' || CAST(ts AS DATE) AS domain, count(*) FILTER (event_type = 'view') AS it_jobs FROM events GROUP BY 1)"""
SQL["list_companies"] = WITH_TREND + "SELECT id, domain, name, it_jobs, jobs_delta, updated_at::VARCHAR AS updated_at FROM trend"
SQL["company_summary"] = WITH_TREND + """SELECT id, domain, name, phone, email, it_hiring, created_at::VARCHAR AS created_at,
  updated_at::VARCHAR AS updated_at FROM companies"""
SQL["search_companies"] = WITH_TREND + "SELECT domain, it_jobs, jobs_delta FROM trend WHERE jobs_delta > 0 AND (lower(name) LIKE '%u1%' OR domain LIKE '%u1%' OR email LIKE '%u1%')"
SQL["has_contact"] = WITH_TREND + "SELECT domain, email, phone FROM companies WHERE coalesce(email, phone) IS NOT NULL"
SQL["rescan_targets"] = WITH_TREND + f"SELECT domain, website AS url, updated_at::VARCHAR AS updated_at FROM companies WHERE updated_at < {EVENTS_AS_OF} - INTERVAL 3 DAY"
SQL["batch_summary"] = WITH_TREND + """SELECT count(*) AS total, count(*) FILTER (it_jobs > 0) AS done, count(*) FILTER (it_jobs = 0) AS failed,
  count(*) FILTER (it_jobs > 0 AND email IS NULL AND phone IS NULL) AS skipped, count(*) FILTER (jobs_delta > 0) AS rising FROM trend"""
SQL["delete_companies"] = WITH_TREND + "SELECT id, domain, it_jobs FROM companies WHERE it_jobs >= 2"

# --- funnel --------------------------------------------------------------------------------

SQL["status_history"] = WITH_HIST + "SELECT id, lead_id, from_status, to_status, \"at\"::VARCHAR AS \"at\" FROM hist"
SQL["orphan_history_filter"] = WITH_HIST + "SELECT id, lead_id, to_status FROM known"
SQL["pipeline_funnel"] = WITH_HIST + """, reach AS (
  SELECT s.pos, s.stage, count(DISTINCT k.lead_id) AS reached FROM stages s
  LEFT JOIN (SELECT k.lead_id, t.pos FROM known k JOIN stages t ON k.to_status = t.stage) k ON k.pos >= s.pos GROUP BY 1, 2)
  SELECT r.stage, r.reached, CASE WHEN r.reached > 0 AND n.reached IS NOT NULL THEN CAST(round_even(n.reached / r.reached * 100, 0) AS BIGINT) END AS conversion,
    (SELECT count(*) FROM known WHERE to_status = 'lost' AND coalesce(from_status, 'new') = r.stage) AS lost,
    (SELECT count(*) FROM known WHERE to_status = 'hold' AND coalesce(from_status, 'new') = r.stage) AS hold,
    (SELECT count(*) FROM fleads WHERE status = r.stage) AS now
  FROM reach r LEFT JOIN reach n ON n.pos = r.pos + 1"""
SQL["stage_intervals"] = WITH_HIST + f"""SELECT id, lead_id, to_status, \"at\"::VARCHAR AS \"at\",
  coalesce(lead(hist.\"at\") OVER (PARTITION BY lead_id ORDER BY hist.\"at\", id), {EVENTS_AS_OF})::VARCHAR AS until FROM hist"""
SQL["stage_durations"] = WITH_HIST + f""", v AS (SELECT to_status, epoch_us(coalesce(lead(\"at\") OVER (PARTITION BY lead_id ORDER BY \"at\", id), {EVENTS_AS_OF})) - epoch_us(\"at\") AS us FROM known)
  SELECT stage, count(us) AS visits, round_even(sum(us) / count(us) / 86400000000, 1) AS avg_days
  FROM stages LEFT JOIN v ON v.to_status = stage AND stage <> 'won' GROUP BY stage"""
SQL["sales_velocity"] = WITH_HIST + """SELECT count(DISTINCT lead_id) AS won, count(*) AS won_events,
  round_even(sum(epoch_us(\"at\") - epoch_us(created_at)) / count(*) / 86400000000, 1) AS velocity_days
  FROM known JOIN fleads ON fleads.id = lead_id WHERE to_status = 'won'"""
SINCE = f"""since AS (SELECT f.id, status, m AS stage_since, CAST(floor((epoch_us({EVENTS_AS_OF}) - epoch_us(m)) / 86400000000) AS BIGINT) AS days_in_stage
  FROM fleads f JOIN (SELECT lead_id, max(\"at\") AS m FROM hist GROUP BY 1) ON lead_id = f.id)"""
SQL["lead_stage_since"] = WITH_HIST + f", {SINCE} SELECT id, status, stage_since::VARCHAR AS stage_since, days_in_stage FROM since"
SQL["stale_stage"] = WITH_HIST + f", {SINCE} SELECT id, days_in_stage, days_in_stage >= 14 AND {OPEN} AS stale FROM since"
SQL["current_stage"] = WITH_HIST + """SELECT lead_id, to_status AS status, \"at\"::VARCHAR AS entered_at FROM hist
  QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY hist.\"at\" DESC, id DESC) = 1"""
SQL["seed_status_history"] = WITH_HIST + """SELECT id AS lead_id, CAST(NULL AS VARCHAR) AS from_status, status AS to_status, created_at::VARCHAR AS \"at\" FROM fleads
  WHERE id NOT IN (SELECT lead_id FROM hist WHERE from_status IS NULL AND to_status = 'new')"""
SQL["append_status_history"] = WITH_HIST + """, n AS (SELECT id, status AS old, CASE WHEN status = 'contacted' THEN 'meeting' ELSE status END AS new,
    id IN (SELECT lead_id FROM hist WHERE to_status = 'lost') AS fresh FROM fleads)
  SELECT id AS lead_id, CASE WHEN NOT fresh THEN old END AS from_status, new AS to_status, '2024-02-01 00:00:00' AS \"at\" FROM n WHERE fresh OR old <> new"""

# --- contracts -----------------------------------------------------------------------------

SQL["normalise_contracts"] = WITH_CONTRACTS + """SELECT id, company_id, domain, company_name, title, biz_number, project_type, status,
  start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, signed_date::VARCHAR AS signed_date, amount, team_size, satisfaction,
  renewal_notice_days, array_to_string(tech, '|') AS tech, memo FROM contracts"""
SQL["contract_flags"] = WITH_CONTRACTS + "SELECT id, days_left, expiring, overdue_end FROM flags"
SQL["list_contracts"] = WITH_CONTRACTS + "SELECT id, company_name, end_date::VARCHAR AS end_date, amount FROM contracts"
SQL["latest_contract"] = WITH_CONTRACTS + f"""SELECT customer_key, id, start_date::VARCHAR AS start_date, amount FROM contracts
  QUALIFY row_number() OVER (PARTITION BY customer_key ORDER BY contracts.start_date DESC, end_date DESC, id DESC) = 1"""
SQL["customer_rollup"] = WITH_CUSTOMERS + """SELECT customer_key, company_name, domain, biz_number, company_id, grade, total_value, active_value,
  contract_count, live_count, active_count, renewed_count, expiring_count, first_signed::VARCHAR AS first_signed, last_end::VARCHAR AS last_end,
  next_end::VARCHAR AS next_end, dormant_days, satisfaction, project_types, tech, latest_amount FROM customers"""
SQL["customer_grade"] = f"""SELECT o_custkey, total_value, live_count, {GRADE.format(t='total_value', n='live_count')} AS grade FROM (
  SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT) * 100) AS BIGINT) AS total_value, count(*) AS live_count FROM orders GROUP BY 1)"""
SQL["contract_summary"] = WITH_CONTRACTS + """SELECT CAST(coalesce(sum(amount) FILTER (status <> 'terminated'), 0) AS BIGINT) AS total_value,
  CAST(coalesce(sum(amount) FILTER (status = 'active'), 0) AS BIGINT) AS active_value, count(*) FILTER (status = 'active') AS active_count,
  CAST(coalesce(sum(amount) FILTER (status <> 'terminated' AND year(signed_date) = 2001), 0) AS BIGINT) AS year_value,
  count(*) FILTER (status <> 'terminated' AND year(signed_date) = 2001) AS year_count, count(*) FILTER (expiring) AS expiring_count,
  CAST(coalesce(sum(amount) FILTER (expiring), 0) AS BIGINT) AS expiring_value, count(DISTINCT customer_key) AS customer_count FROM flags"""
SQL["grade_counts"] = WITH_CUSTOMERS + """SELECT g AS grade, count(customer_key) AS customers FROM (VALUES ('S'),('A'),('B'),('C')) t(g)
  LEFT JOIN customers ON grade = g GROUP BY 1"""
SQL["list_customers"] = WITH_CUSTOMERS + "SELECT customer_key, company_name, total_value, grade FROM customers"
SQL["search_customers"] = WITH_CUSTOMERS + """SELECT customer_key, grade, expiring_count FROM customers WHERE expiring_count > 0
  AND customer_key IN (SELECT customer_key FROM contracts WHERE memo LIKE '%urgent%')"""
KRW = "'₩' || format('{{:,}}', {a})"
SQL["resell_leads"] = WITH_CUSTOMERS + f""", h AS (SELECT customer_key, string_agg(title || ' ' || start_date || '~' || end_date || ' ' || {KRW.format(a='amount')}, '; ' ORDER BY rn) AS h FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY {NEWEST}) AS rn FROM contracts) WHERE rn <= 5 GROUP BY 1)
  SELECT customer_key, 'customer' AS source, latest_project_type AS project_type, latest_amount AS budget, latest_team_size AS team_size, 'contacted' AS status,
    '기존 고객 (등급 ' || grade || ', 누적 ' || {KRW.format(a='total_value')} || '). 계약 이력: ' || h AS memo FROM customers JOIN h USING (customer_key)"""
SQL["contract_template_for_customer"] = WITH_CUSTOMERS + """SELECT customer_key, company_name, domain, latest_project_type AS project_type,
  latest_team_size AS team_size, tech FROM customers"""
SQL["export_contracts"] = WITH_CUSTOMERS + """SELECT grade, c.company_name, title, project_type, status, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date,
  amount::VARCHAR AS amount, coalesce(team_size::VARCHAR, '') AS team_size, array_to_string(c.tech, ' | ') AS tech, c.satisfaction::VARCHAR AS satisfaction
  FROM contracts c JOIN customers USING (customer_key)"""
SQL["customer_documents"] = WITH_CUSTOMERS + f"""SELECT c.customer_key, k.grade, row_number() OVER (PARTITION BY c.customer_key ORDER BY {NEWEST}) AS position, id, amount
  FROM contracts c JOIN customers k ON c.customer_key = k.customer_key"""
SQL["delete_contracts"] = WITH_CONTRACTS + """SELECT id, status, amount FROM contracts WHERE status <> 'terminated'"""

# --- leads ---------------------------------------------------------------------------------

SQL["normalise_leads"] = WITH_LEADS + """SELECT id, domain, company_name, website, biz_number, industry, company_size, contact_name, rank, phone, mobile, email, kakao,
  source, project_type, array_to_string(tech, '|') AS tech, budget, team_size, expected_start, false AS bridge_se, lost_reason, it_hiring, status, assignee,
  next_action, next_date::VARCHAR AS next_date, last_contact::VARCHAR AS last_contact, memo FROM leads"""
SQL["normalise_leads_errors"] = WITH_LEADS + "SELECT k AS row, 'email_invalid' AS code FROM base WHERE b % 5 = 0"
SQL["norm_rank"] = WITH_LEADS + "SELECT id AS row, rank FROM rawl"
SQL["norm_budget"] = WITH_LEADS + "SELECT id AS row, budget FROM rawl"
SQL["norm_phone"] = WITH_LEADS + "SELECT id AS row, coalesce(mobile, phone) AS phone, biz_number FROM rawl"
SQL["norm_dates"] = WITH_LEADS + "SELECT id AS row, next_date::VARCHAR AS next_date, expected_start FROM rawl"
SQL["score_leads"] = WITH_LEADS + "SELECT id, score, parts FROM leads"
SQL["lead_kpis"] = WITH_LEADS + f"""SELECT count(*) FILTER ({OPEN}) AS open_leads, CAST(coalesce(sum(budget) FILTER ({OPEN}), 0) AS BIGINT) AS pipeline,
  count(*) FILTER (status = 'won') AS won, count(*) FILTER (status = 'lost') AS lost,
  count(*) FILTER (date_trunc('month', created_at) = DATE '2024-02-01') AS new_this_month,
  count(*) FILTER (date_trunc('month', created_at) = DATE '2024-02-01' AND score >= 80) AS hot_this_month,
  count(*) FILTER ({OPEN} AND next_date < DATE '2024-02-01') AS overdue,
  CAST(round(count(*) FILTER (status = 'won') * 100.0 / count(*) FILTER (status IN ('won', 'lost'))) AS BIGINT) AS win_rate FROM leads"""
SQL["status_counts"] = WITH_LEADS + f", {STATUS_DIM} SELECT d.status, count(id) AS leads FROM dim d LEFT JOIN leads l USING (status) GROUP BY 1"
SQL["kanban_totals"] = WITH_LEADS + f", {STATUS_DIM} SELECT d.status, count(id) AS leads, CAST(coalesce(sum(budget), 0) AS BIGINT) AS budget FROM dim d LEFT JOIN leads l USING (status) GROUP BY 1"
SQL["assignees"] = WITH_LEADS + "SELECT DISTINCT assignee FROM leads WHERE assignee IS NOT NULL"
SQL["list_leads"] = WITH_LEADS + "SELECT id, company_name, status, created_at || ' 00:00:00' AS updated_at FROM leads"
SQL["overdue_leads"] = WITH_LEADS + f"SELECT id, status, next_date::VARCHAR AS next_date, coalesce({OPEN} AND next_date < DATE '2024-02-01', false) AS overdue FROM leads"
SQL["search_leads"] = WITH_LEADS + f"SELECT id, status, next_date::VARCHAR AS next_date FROM leads WHERE {OPEN} AND leads.next_date BETWEEN DATE '2024-02-01' AND DATE '2024-02-08'"
SQL["search_hot_leads"] = WITH_LEADS + "SELECT id, score FROM leads WHERE score >= 80 AND assignee = 'rep 2' AND industry = 'Furniture'"
SQL["match_leads_to_company"] = WITH_LEADS + """, lm AS (SELECT id, domain, CASE WHEN it_hiring = 'High' THEN id + 7 END AS company_id FROM leads)
  SELECT c_custkey + 7 AS id, slug || '.co.kr' AS domain, coalesce((SELECT min(id) FROM lm WHERE company_id = c.c_custkey + 7),
    (SELECT min(id) FROM lm WHERE lm.domain = slug || '.co.kr')) AS lead_id
  FROM (SELECT c_custkey, replace(lower(c_name), '#', '-') AS slug FROM customer) c"""
SQL["companies_without_lead"] = WITH_LEADS + """SELECT c_custkey + 7 AS id, slug || '.co.kr' AS domain FROM (SELECT c_custkey, replace(lower(c_name), '#', '-') AS slug FROM customer)
  WHERE slug || '.co.kr' NOT IN (SELECT domain FROM leads WHERE domain IS NOT NULL)"""
SQL["match_leads_to_customers"] = (f"WITH {CONTRACTS}, {FLAGS}, {CUSTOMERS}, {BASE}, {RAW}, {POINTS}, {LEADS} " +
  """SELECT l.id, coalesce(d.customer_key, n.customer_key) AS customer_key, coalesce(d.grade, n.grade) AS customer_grade FROM leads l
  LEFT JOIN customers d ON d.customer_key = l.domain LEFT JOIN customers n ON lower(n.company_name) = lower(l.company_name)""")
SQL["duplicate_summary"] = WITH_LEADS + """, probes AS (SELECT id AS probe_id, CASE WHEN assignee IS NULL THEN lower(company_name) END AS nm,
    domain AS dm, CASE WHEN b % 5 = 0 THEN 'not-an-email' ELSE email END AS em FROM rawl),
  hits AS (SELECT probe_id, id, CASE WHEN l.domain = dm THEN 0 WHEN l.email = em THEN 1 ELSE 2 END AS r FROM probes JOIN leads l
    ON l.domain = dm OR l.email = em OR lower(l.company_name) = nm)
  SELECT p.probe_id, count(h.id) AS matches, ['domain', 'email', 'name'][min(r) + 1] AS reason, min(h.id) AS first_id
  FROM probes p LEFT JOIN hits h USING (probe_id) GROUP BY 1"""
ACTS = """acts AS (SELECT conv_id * 1000 + turn AS id, conv_id AS lead_id, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'email' ELSE 'visit' END AS type,
    DATE '2024-01-01' + CAST(turn AS INT) AS \"at\", text FROM conversations)"""
SQL["lead_activities"] = WITH_LEADS + f", {ACTS} SELECT id, lead_id, type, \"at\"::VARCHAR AS \"at\" FROM acts WHERE lead_id IN (SELECT id FROM leads)"
SQL["add_activities"] = WITH_LEADS + f""", {ACTS} SELECT l.id, CAST(greatest(last_contact, coalesce(mx, last_contact)) AS VARCHAR) AS last_contact,
  CASE WHEN mx IS NULL THEN created_at || ' 00:00:00' ELSE '2024-02-01 00:00:00' END AS updated_at
  FROM leads l LEFT JOIN (SELECT lead_id, max(\"at\") AS mx FROM acts GROUP BY 1) ON lead_id = l.id"""
SQL["add_activities_rows"] = WITH_LEADS + f""", {ACTS} SELECT id, lead_id, CASE WHEN type = 'visit' THEN 'other' ELSE type END AS type, \"at\"::VARCHAR AS \"at\",
  md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS note FROM acts WHERE lead_id IN (SELECT id FROM leads)"""
SQL["delete_leads"] = WITH_LEADS + f""", {ACTS} SELECT 'leads' AS tbl, id FROM leads WHERE status NOT IN ('lost', 'hold')
  UNION ALL SELECT 'activities', id FROM acts WHERE lead_id NOT IN (SELECT id FROM leads WHERE status IN ('lost', 'hold'))
  UNION ALL SELECT 'history', id FROM leads WHERE status NOT IN ('lost', 'hold')"""
SQL["write_leads"] = WITH_LEADS + """SELECT id, CASE WHEN status = 'proposal' THEN 'ceo' ELSE rank END AS rank, CASE WHEN status <> 'proposal' THEN phone END AS phone,
  CASE WHEN status = 'proposal' THEN 'lost' ELSE status END AS status, CASE WHEN status = 'proposal' THEN 'price' ELSE lost_reason END AS lost_reason,
  CASE WHEN status = 'proposal' THEN least(100, p_hiring + 22 + p_email + CASE WHEN mobile IS NOT NULL THEN 10 ELSE 0 END + p_kakao + p_budget + p_source + p_project
    + p_biz + p_timing + p_team) ELSE score END AS score,
  CASE WHEN status = 'proposal' THEN '2024-02-01 00:00:00' ELSE created_at || ' 00:00:00' END AS updated_at FROM leads"""
SQL["change_status"] = WITH_LEADS + """SELECT id AS lead_id, status AS from_status, 'won' AS to_status, '2024-02-01 00:00:00' AS \"at\" FROM leads
  WHERE score >= 60 AND status <> 'won'"""
SQL["write_contracts"] = WITH_CONTRACTS + """SELECT id, CASE WHEN status = 'renewed' THEN 250000000 ELSE amount END AS amount,
  CASE WHEN status <> 'renewed' THEN satisfaction END AS satisfaction, CASE WHEN status <> 'renewed' THEN memo END AS memo,
  end_date::VARCHAR AS end_date, array_to_string(tech, '|') AS tech FROM contracts"""
SQL["contracts_from_leads"] = WITH_LEADS + """SELECT id AS lead_id, domain, company_name, budget AS amount, team_size, expected_start || '-01' AS start_date,
  coalesce(mobile, phone) AS phone, assignee AS our_pm FROM leads WHERE status = 'won'"""
SQL["calendar_events"] = (f"WITH {BASE}, {RAW}, {POINTS}, {LEADS}, {CONTRACTS} " + f"""
  SELECT 'lead-' || id AS uid, next_date::VARCHAR AS date, '[CRM] ' || company_name || coalesce(' — ' || next_action, '') AS summary,
    concat_ws(chr(10), contact_name, coalesce(mobile, phone), email, memo) AS description FROM leads WHERE {OPEN} AND next_date IS NOT NULL
  UNION ALL SELECT 'contract-' || id || '-notice', CAST(end_date - CAST(renewal_notice_days AS INT) AS VARCHAR),
    '[계약 만료 ' || renewal_notice_days || '일 전] ' || company_name || ' — 재계약 제안', title || chr(10) || '만료 ' || end_date || ' · ' || {KRW.format(a='amount')}
    FROM contracts WHERE status = 'active'
  UNION ALL SELECT 'contract-' || id || '-end', end_date::VARCHAR, '[계약 만료] ' || company_name, title FROM contracts WHERE status = 'active'""")
SQL["label_codes"] = WITH_LEADS + """SELECT id, CASE status WHEN 'new' THEN '신규' WHEN 'contacted' THEN '접촉' WHEN 'meeting' THEN '미팅·니즈 파악' WHEN 'proposal' THEN '제안·견적'
    WHEN 'negotiation' THEN '협상·계약 검토' WHEN 'won' THEN '수주' WHEN 'lost' THEN '실패' ELSE '보류' END AS status,
  CASE rank WHEN 'cto' THEN 'CTO (최고기술책임자)' WHEN 'cio' THEN 'CIO (최고정보책임자)' WHEN 'director' THEN '이사' WHEN 'ceo' THEN '대표이사' WHEN 'manager' THEN '과장' WHEN 'other' THEN '기타' END AS rank,
  CASE company_size WHEN 'enterprise' THEN '대기업' WHEN 'midsize' THEN '중견기업' WHEN 'sme' THEN '중소기업' WHEN 'public' THEN '공공기관' END AS company_size FROM leads"""
SQL["export_leads"] = WITH_LEADS + """SELECT company_name, coalesce(CASE rank WHEN 'cto' THEN 'CTO' WHEN 'cio' THEN 'CIO' WHEN 'director' THEN 'Giám đốc (이사)' WHEN 'ceo' THEN 'Tổng giám đốc (대표이사)'
    WHEN 'manager' THEN 'Trưởng nhóm (과장)' WHEN 'other' THEN 'Khác' END, '') AS rank, array_to_string(tech, ' | ') AS tech, coalesce(budget::VARCHAR, '') AS budget, '' AS bridge_se,
  CASE status WHEN 'new' THEN 'Mới' WHEN 'contacted' THEN 'Đã liên hệ' WHEN 'meeting' THEN 'Họp · khảo sát nhu cầu' WHEN 'proposal' THEN 'Đề xuất · báo giá'
    WHEN 'negotiation' THEN 'Đàm phán · rà soát HĐ' WHEN 'won' THEN 'Thắng thầu' WHEN 'lost' THEN 'Thua' ELSE 'Tạm dừng' END AS status,
  coalesce(next_date::VARCHAR, '') AS next_date, score::VARCHAR AS score FROM leads"""
NF = "'찾을 수 없음'"
SQL["export_companies"] = WITH_TREND + f"""SELECT name, {NF} AS biz_number, {NF} AS ceo, {NF} AS address, coalesce(phone, {NF}) AS phone, coalesce(email, {NF}) AS email,
  {NF} AS industry, website, CASE it_hiring WHEN 'High' THEN '높음' WHEN 'Medium' THEN '보통' WHEN 'Low' THEN '낮음' ELSE '없음' END AS it_hiring,
  it_jobs::VARCHAR AS it_jobs, coalesce(jobs_delta::VARCHAR, '') AS jobs_delta, contacts::VARCHAR AS contacts, strftime(updated_at, '%Y. %m. %d.') AS updated_at FROM trend"""
SQL["format_krw"] = WITH_LEADS + """SELECT id, CASE WHEN coalesce(budget, 0) <= 0 THEN '' WHEN budget >= 100000000 AND budget % 100000000 = 0 THEN '₩ ' || budget // 100000000 || '억'
    WHEN budget >= 100000000 THEN '₩ ' || CAST(round(CAST(budget AS DECIMAL(18,0)) / 100000000::DECIMAL(12,0), 1) AS DECIMAL(18,1)) || '억'
    WHEN budget >= 10000 THEN '₩ ' || format('{:,}', CAST(round(budget / 10000) AS BIGINT)) || '만' ELSE '₩ ' || budget END AS ko,
  CASE WHEN coalesce(budget, 0) <= 0 THEN ''
    WHEN budget >= 1000000000 THEN regexp_replace(translate(format('{:,.1f}', CAST(round(budget / 1e9, 1) AS DOUBLE)), ',.', '.,'), ',0$', '') || ' tỷ ₩'
    WHEN budget >= 1000000 THEN regexp_replace(translate(format('{:,.1f}', CAST(round(budget / 1e6, 1) AS DOUBLE)), ',.', '.,'), ',0$', '') || ' triệu ₩'
    ELSE replace(format('{:,}', budget), ',', '.') || ' ₩' END AS vi FROM leads"""
FILL = ("replace(replace(replace(replace(replace(replace(replace({t}, '{{company}}', company_name), '{{contact}}', contact_name || ' ' || rk || '님'), '{{tech}}', array_to_string(tech, ', ')), "
        "'{{team}}', CASE WHEN team_size <> 0 THEN team_size || '명 규모의 ' ELSE '' END), '{{start}}', coalesce(expected_start || ' 착수 기준으로 ', '')), '{{project}}', pj), '{{signature}}', 'Kim')")
SQL["mail_drafts"] = WITH_LEADS + f""", t(kind, subject, body) AS (VALUES
    ('cold', '[{{company}}] {{tech}}', '{{contact}}, {{company}}.' || chr(10) || chr(10) || '{{team}}{{tech}}' || chr(10) || chr(10) || '{{project}}' || chr(10) || chr(10) || '{{signature}}'),
    ('quote', '[{{company}}] quote', '{{contact}}' || chr(10) || '{{start}}{{project}}' || repeat(chr(10), 4) || '{{signature}}')),
  v AS (SELECT *, CASE rank WHEN 'cto' THEN 'CTO' WHEN 'cio' THEN 'CIO' WHEN 'director' THEN '이사' WHEN 'ceo' THEN '대표이사' WHEN 'manager' THEN '과장' WHEN 'other' THEN '기타' ELSE '담당자' END AS rk,
    CASE project_type WHEN 'dispatch' THEN '파견' WHEN 'si' THEN 'SI 구축' ELSE '파견·도급·ODC 전담팀' END AS pj FROM leads)
  SELECT id, kind, email AS to, {FILL.format(t='subject')} AS subject, regexp_replace({FILL.format(t='body')}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM v, t"""
IMPORT = f"""imp AS (SELECT id AS row, industry AS company_name, 'P' || (id // 2) AS contact_name,
    CASE WHEN n5 = 2 THEN CASE WHEN b % 5 = 0 THEN 'not-an-email' WHEN b % 5 < 4 THEN slug2 || '@Mail.co.kr' END END AS email,
    CASE WHEN n5 = 3 THEN NULL ELSE budget_text END AS budget
  FROM (SELECT rawl.*, source, CASE source WHEN 'website' THEN 2 WHEN 'coldcall' THEN 3 ELSE 0 END AS n5, replace(lower(company_name), '#', '-') AS slug2,
    CASE source WHEN 'referral' THEN '₩ ' || b || '억 5000만' WHEN 'exhibition' THEN b || ',000,000' WHEN 'website' THEN '2.5억' WHEN 'other' THEN b || '만' END AS budget_text FROM rawl)),
  keyed AS (SELECT *, coalesce(lower(email), '|' || lower(company_name) || '|' || lower(contact_name)) AS key, email = 'not-an-email' AS bad FROM imp),
  old AS (SELECT DISTINCT coalesce(email, '|' || lower(industry) || '|' || lower('P' || id)) AS key FROM leads WHERE source = 'website' OR it_hiring = 'High'),
  classed AS (SELECT *, CASE WHEN bad THEN 'email_invalid' WHEN key IN (SELECT key FROM old) OR row <> first_row THEN 'duplicate' ELSE 'new' END AS outcome
    FROM (SELECT keyed.*, coalesce(bad, false) AS b2, min(row) FILTER (NOT coalesce(bad, false)) OVER (PARTITION BY key) AS first_row FROM keyed))"""
WITH_IMPORT = f"WITH {BASE}, {RAW}, {POINTS}, {LEADS}, {IMPORT} "
SQL["map_import_columns"] = WITH_IMPORT + "SELECT row, company_name, contact_name, email, 'exhibition' AS source, 'meeting' AS status, budget FROM imp"
SQL["import_classify"] = WITH_IMPORT + "SELECT row, outcome FROM classed"
SQL["import_report"] = WITH_IMPORT + """SELECT count(*) AS total, count(*) FILTER (outcome = 'new') AS valid, count(*) FILTER (outcome = 'duplicate') AS duplicates,
  count(*) FILTER (outcome = 'email_invalid') AS errors, count(*) FILTER (outcome = 'new') AS inserted FROM classed"""
SQL["import_preview"] = WITH_IMPORT + f"""SELECT c.row, c.company_name, c.contact_name, lower(c.email) AS email, 'exhibition' AS source, l.budget
  FROM classed c JOIN rawl l ON l.id = c.row WHERE outcome = 'new' ORDER BY c.row LIMIT 5"""

# --- addresses -----------------------------------------------------------------------------

TYPED = """typed AS (SELECT c_custkey AS id, f, slug, k, CASE f WHEN 0 THEN 'www.' || slug || '.co.kr' WHEN 1 THEN 'http://10.0.' || k || '.1/x' WHEN 2 THEN 'https://' || slug || '.com:8443/a?b=1#c'
    WHEN 3 THEN 'ftp://' || slug || '.com' WHEN 4 THEN 'http://172.20.1.' || k WHEN 5 THEN 'http://8.8.4.' || k WHEN 6 THEN 'localhost:8080/' || slug WHEN 7 THEN 'http://' || slug || '.local'
    WHEN 8 THEN 'http://' || slug || '.com:22' WHEN 9 THEN 'HTTP://' || slug || '.NET' WHEN 10 THEN 'http://169.254.169.254/' || slug WHEN 11 THEN 'https://[::1]/'
    WHEN 12 THEN 'https://[2400:cb00::' || k || ']/p' ELSE ' ' END AS url
  FROM (SELECT *, c_nationkey % 14 AS f, replace(lower(c_name), '#', '-') AS slug, (c_custkey % 200)::VARCHAR AS k FROM customer))"""
SQL["admissible_urls"] = f"WITH {TYPED} " + """SELECT id, CASE f WHEN 0 THEN 'https://' || url || '/' WHEN 2 THEN 'https://' || slug || '.com:8443/a?b=1' WHEN 3 THEN NULL WHEN 4 THEN url || '/' WHEN 5 THEN url || '/'
    WHEN 6 THEN 'https://' || url WHEN 7 THEN url || '/' WHEN 8 THEN url || '/' WHEN 9 THEN 'http://' || slug || '.NET/' WHEN 13 THEN NULL ELSE url END AS normal_url,
  f IN (0, 2, 5, 9, 12) AS ok, CASE f WHEN 1 THEN 'private_address' WHEN 3 THEN 'scheme' WHEN 4 THEN 'private_address' WHEN 6 THEN 'blocked_host' WHEN 7 THEN 'blocked_host' WHEN 8 THEN 'port'
    WHEN 10 THEN 'private_address' WHEN 11 THEN 'private_address' WHEN 13 THEN 'empty' END AS reason FROM typed"""
REG = """CASE WHEN len(string_split({h}, '.')) <= 2 THEN {h} WHEN string_split({h}, '.')[-2] IN ('co','or','ne','go','re','pe','kg','ac','ms','hs','es','sc','com','net','org','gov','edu','mil')
  THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"""
HOST = "lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1))"
SQL["registrable_domain"] = f"""WITH {TYPED}, h AS (SELECT page_id, {HOST.format(u='url')} AS h FROM pages UNION ALL
  SELECT id + 10000000, CASE WHEN f = 11 THEN '::1' WHEN f = 12 THEN '2400:cb00::' || k ELSE {HOST.format(u='url')} END FROM typed)
  SELECT page_id, {REG.format(h='h')} AS domain FROM h"""
SQL["same_domain"] = "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.org([/?#]|$)')"
HREFS = "hrefs AS (SELECT page_id, url AS base_url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS h FROM pages))"
SQL["clean_links"] = f"""WITH {HREFS}, x AS (SELECT *, (page_id + pos) % 8 AS f, regexp_extract(base_url, '^https?://[^/?#]*') AS origin,
    regexp_extract(base_url, '^https?://[^/?#]*([^?#]*)', 1) AS p, split_part(base_url, ':', 1) AS sch FROM hrefs),
  up AS (SELECT *, regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '[^/]*$', '') AS folder FROM x)
  SELECT page_id, pos, CASE f WHEN 0 THEN origin || href WHEN 1 THEN origin || regexp_replace(folder, '[^/]*/$', '') || href[2:] WHEN 2 THEN 'https://other.example.org' || href
    WHEN 3 THEN origin || CASE WHEN p = '' THEN '/' ELSE p END || '?q=1' WHEN 7 THEN sch || '://cdn.example.net' || href END AS url FROM up
  WHERE f IN (0, 1, 2, 3, 7) AND NOT (f = 1 AND folder = '/' AND false)"""
KEY = "regexp_replace({h}, '^www\\.', '') || rtrim(CASE WHEN {p} = '' THEN '/' ELSE {p} END, '/') || '?' || regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
PATH = "regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
URL_KEY = KEY.format(h=HOST.format(u="url"), p=PATH.format(u="url"), u="url")
SQL["url_key"] = f"SELECT page_id, {URL_KEY} AS url_key FROM pages"
SQL["read_url_list"] = f"""WITH w AS (SELECT line, unnest(ws) AS url, generate_subscripts(ws, 1) - 1 AS pos FROM (
    SELECT page_id AS line, regexp_split_to_array(url || '; # note, ' || {HOST.format(u='url')}, '[\\n,;\\t ]+') AS ws FROM pages)),
  k AS (SELECT *, rtrim(regexp_replace(lower(url), '^https?://', ''), '/') AS key FROM w WHERE url <> '' AND url NOT LIKE '#%')
  SELECT line, pos, url FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY line, pos) = 1"""
SQL["sniff_urls"] = "SELECT page_id AS line, 0 AS pos, regexp_replace(url, '(https?://[^/?#]*)?((/[^ ]*)?)([?#][^ ]*)?', '\\1\\2') AS url FROM pages"

# --- pages ---------------------------------------------------------------------------------

WS = "[\\s\\x{00a0}\\x{0085}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
HIDE = "'(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<svg\\b[^>]*>.*?</svg\\s*>|<template\\b[^>]*>.*?</template\\s*>'"
ENT = "replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
def _text(html: str) -> str:
    marked = ENT.format(x=f"regexp_replace({html}, '(?s)</?[a-zA-Z!?][^>]*>', chr(1), 'g')")
    joined = f"regexp_replace({marked}, '({WS}|\\x01)*\\x01({WS}|\\x01)*', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({joined}, '^{WS}+|{WS}+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
VISIBLE = _text(f"regexp_replace(html, {HIDE}, chr(1), 'g')")
TEXTS = f"texts AS (SELECT *, {VISIBLE} AS text FROM pages)"
TITLE = _text("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")
PAGES = f"""pg0 AS (SELECT page_id AS page_idx, url, html, text, {TITLE} AS title, {REG.format(h=HOST.format(u='url'))} AS domain FROM texts),
  pg AS (SELECT *, page_idx = min(page_idx) OVER (PARTITION BY domain) AS home FROM pg0)"""
WITH_PAGES = f"WITH {TEXTS}, {PAGES} "
SQL["read_pages"] = "SELECT page_id, url, length(html) AS chars FROM pages"
SQL["page_text"] = f"WITH {TEXTS} SELECT page_id, length(text) AS chars, md5(text) AS text FROM texts"
SQL["page_title"] = f"SELECT page_id, {TITLE} AS title FROM pages"
FOOT = _text("array_to_string(regexp_extract_all(html, '(?is)<footer\\b[^>]*>.*?</footer\\s*>'), '<br>')")
SQL["footer_text"] = f"""WITH {TEXTS}, l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM texts),
  f AS (SELECT page_id, concat_ws(chr(10), nullif({FOOT}, ''), array_to_string(lines[CAST(floor(len(lines) * 0.75) AS BIGINT) + 1:], chr(10))) AS footer FROM l)
  SELECT page_id, length(footer) AS chars, md5(footer) AS footer FROM f"""
SQL["js_shell_pages"] = f"WITH {TEXTS} SELECT page_id, length(text) < 3000 AND (length(text) < 1500 OR lower(html) LIKE '%ng-app%') AS js_shell FROM texts"
CATS = "CASE WHEN home THEN 'home' ELSE 'other' END"
SQL["content_category"] = WITH_PAGES + f""", h AS (SELECT page_idx, home, lower(title || ' ' || text) AS h FROM pg)
  SELECT page_idx, CASE WHEN home THEN 'home' WHEN h LIKE '%nicht %' OR h LIKE '%para %' THEN 'recruitment'
    WHEN (h LIKE '%que %')::INT + (h LIKE '%les %')::INT + (h LIKE '%the %')::INT >= 2 THEN 'management' ELSE 'other' END AS category FROM h"""
LINKS = f"""lk AS (SELECT domain, home, page_idx AS from_idx, url AS base, unnest(h) AS href, unnest(a) AS anchor, generate_subscripts(h, 1) - 1 AS pos FROM (
    SELECT *, regexp_extract_all(html, '<a href=\"([^\"]*)\">(.*?)</a>', 1) AS h, regexp_extract_all(html, '<a href=\"([^\"]*)\">(.*?)</a>', 2) AS a FROM pg)),
  links AS (SELECT domain, home, from_idx, pos, trim({ENT.format(x='anchor')}) AS anchor, regexp_extract(base, '^https?://[^/?#]*') || {ENT.format(x='href')} AS url, base FROM lk)"""
def _tok(words: str, x: str) -> str:
    return f"regexp_matches({x}, '(^|[^a-z])({words})([^a-z]|$)')"
TGT = "lower(" + PATH.format(u="url") + ") || ' '"
CAT = f"""CASE WHEN {_tok('the|que', TGT)} OR {_tok('the|que', 'lab')} THEN 'recruitment'
    WHEN regexp_matches(lower({PATH.format(u='url')}), '(^|/)(der|und|las)(\\.[^./]*)?(/|$)') OR {_tok('der|und|las', 'lab')} THEN 'management'
    WHEN {_tok('and|en|ie', TGT)} OR {_tok('and|en|ie', 'lab')} THEN 'company' WHEN {_tok('de|of|un', TGT)} OR {_tok('de|of|un', 'lab')} THEN 'contact' END"""
CLASSED = f"classed AS (SELECT *, {CAT} AS category FROM (SELECT *, CASE WHEN length(anchor) > 30 THEN '' ELSE lower(anchor) END AS lab FROM links))"
LANG = "regexp_extract(lower(" + PATH.format(u="{u}") + "), '^/*([^/]*)', 1)"
FOREIGN_SET = "('en','eng','english','en-us','en-gb','us','uk','global','jp','ja','jpn','japanese','ja-jp','cn','zh','chn','chinese','zh-cn','zh-tw','tw','vi','vn','vie','de','fr','es','ru','th','id')"
KOREAN_SET = "('kr','ko','kor','korean','ko-kr')"
def _lang(u: str) -> str:
    s = LANG.format(u=u)
    return f"CASE WHEN {s} IN {FOREIGN_SET} OR {s} IN {KOREAN_SET} THEN {s} END"
def _foreign(u: str, h: str) -> str:
    return f"coalesce(CASE WHEN {_lang(h)} IS NULL THEN {_lang(u)} IN {FOREIGN_SET} ELSE {_lang(u)} <> {_lang(h)} END, false)"
WITH_LINKS = f"WITH {TEXTS}, {PAGES}, {LINKS}, {CLASSED} "
SCORED = f"""scored0 AS (SELECT c.domain, c.url, c.category, c.from_idx, c.pos, c.home,
    CASE category WHEN 'recruitment' THEN 40 WHEN 'management' THEN 34 WHEN 'company' THEN 30 ELSE 28 END
    - least(length({PATH.format(u='c.url')}) - length(replace({PATH.format(u='c.url')}, '/', '')), 5)
    - CASE WHEN {_foreign('c.url', 'h.url')} THEN 30 ELSE 0 END - CASE WHEN c.home THEN 0 ELSE 5 END AS score
  FROM classed c JOIN (SELECT domain, url FROM pg WHERE home) h USING (domain) WHERE category IS NOT NULL),
  scored AS (SELECT domain, url, category, score, from_idx, pos, CASE WHEN home THEN 1 ELSE 2 END AS link_depth FROM scored0
    QUALIFY row_number() OVER (PARTITION BY domain, url ORDER BY score DESC, home DESC, from_idx, pos) = 1)"""
SQL["extract_links"] = WITH_LINKS + "SELECT domain, from_idx, pos, url, anchor, false AS is_frame FROM links"
SQL["classify_links"] = WITH_LINKS + "SELECT from_idx, pos, category FROM classed"
SQL["foreign_language_links"] = WITH_PAGES + f"SELECT p.page_idx, {_foreign('p.url', 'h.url')} AS foreign FROM pg p JOIN (SELECT domain, url FROM pg WHERE home) h USING (domain)"
SQL["score_links"] = WITH_LINKS + f", {SCORED} SELECT domain, url, category, CAST(score AS BIGINT) AS score, CAST(link_depth AS BIGINT) AS link_depth FROM scored"
SQL["crawl_plan"] = WITH_LINKS + f""", {SCORED}, s1 AS (SELECT *, {URL_KEY} AS k FROM scored QUALIFY row_number() OVER (PARTITION BY domain, {URL_KEY} ORDER BY score DESC, link_depth, from_idx, pos, url) = 1),
  s2 AS (SELECT *, CASE WHEN category = 'recruitment' AND row_number() OVER (PARTITION BY domain, category ORDER BY score DESC, link_depth, from_idx, pos, url) > 8 THEN 1 ELSE 0 END AS phase FROM s1),
  sp0 AS (SELECT domain, url, from_idx, pos, {URL_KEY} AS k, {PATH.format(u='url')} AS p FROM classed WHERE category IS NULL
    AND NOT regexp_matches(lower({PATH.format(u='url')}), '/news|/press|/blog|/insight|/media|/gallery|/portfolio|/column|/archive|/event|/faq|/notice|/story|/case')),
  sp AS (SELECT *, -(((length(p) - length(replace(p, '/', ''))) * 100000) + length(url)) AS score FROM sp0 WHERE (domain, k) NOT IN (SELECT (domain, k) FROM s1)
    QUALIFY row_number() OVER (PARTITION BY domain, k ORDER BY -(((length(p) - length(replace(p, '/', ''))) * 100000) + length(url)) DESC, from_idx, pos, url) = 1),
  q AS (SELECT domain, url, category, score, link_depth, from_idx, pos, phase FROM s2 UNION ALL SELECT domain, url, 'other', score, 1, from_idx, pos, 2 FROM sp)
  SELECT domain, rank, url, category, CAST(phase AS BIGINT) AS phase FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY phase, score DESC, link_depth, from_idx, pos, url) AS rank FROM q) WHERE rank <= 19"""
SQL["link_graph"] = WITH_LINKS + f""", t AS (SELECT domain, {URL_KEY} AS k, min(page_idx) AS to_idx FROM pg GROUP BY 1, 2),
  e AS (SELECT DISTINCT domain, from_idx, url, {URL_KEY} AS k FROM links) SELECT domain, from_idx, url AS to_url, to_idx FROM e LEFT JOIN t USING (domain, k)"""
SQL["dedupe_pages"] = WITH_PAGES + f""", a AS (SELECT *, {URL_KEY} AS k, CASE WHEN text <> '' AND NOT home THEN md5(text) END AS f FROM pg),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY domain, k ORDER BY page_idx) = 1)
  SELECT domain, page_idx, url FROM b QUALIFY f IS NULL OR row_number() OVER (PARTITION BY domain, f ORDER BY page_idx) = 1"""
SQL["dedupe_documents"] = """SELECT doc_id AS page_idx FROM documents
  QUALIFY text = '' OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
SQL["within_budget"] = WITH_PAGES + "SELECT domain, page_idx FROM pg QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_idx) <= 20"

# --- facts, people, openings ---------------------------------------------------------------

EMAIL = "'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'"
def _tidy(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(160), ' '), '{WS}+', ' ', 'g'), ' ·|/-–—:：,' || chr(9) || chr(13) || chr(10))"
def _label(label: str) -> str:
    return f"nullif({_tidy(f'''regexp_extract(text, '(?i){label}{WS}*={WS}*([^\\n|·•]{{2,}})', 1)''')}, '')"
SQL["label_value"] = f"""SELECT page_idx, value FROM (SELECT doc_id AS page_idx, coalesce({_label('secret')}, {_label('token')}, {_label('key')}) AS value FROM documents) WHERE value IS NOT NULL"""
URL_OF = "'https://' || source || '.example.net/doc/' || doc_id"
SQL["company_phone"] = f"""WITH p AS (SELECT source AS domain, doc_id, {URL_OF} AS source_url,
    coalesce(nullif(regexp_extract(text, '(?i)tel\\s*[:：]?\\s*(\\+1 \\(\\d{{3}}\\) \\d{{3}}-\\d{{4}})', 1), ''), nullif(regexp_extract(text, '(?i)phone\\s*[:：]?\\s*(\\+1 \\(\\d{{3}}\\) \\d{{3}}-\\d{{4}})', 1), ''),
      nullif(regexp_extract(text, '\\+1 \\(\\d{{3}}\\) \\d{{3}}-\\d{{4}}'), '')) AS value FROM documents)
  SELECT domain, value, source_url FROM p WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY doc_id) = 1"""
MAILS = f"mails AS (SELECT doc_id, source, unnest(m) AS email, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(text, {EMAIL}) AS m FROM documents))"
USABLE = """length(email) <= 100 AND NOT regexp_matches(lower(email), 'noreply|no-reply|that\\.') AND NOT regexp_matches(lower(email), '\\.(png|jpg|jpeg|gif|svg|webp|js|css)$')
  AND length(split_part(email, '@', 1)) <= 64 AND NOT regexp_matches(split_part(email, '@', 2), '^\\.|\\.\\.|\\.$')"""
SQL["usable_emails"] = f"WITH {MAILS} SELECT doc_id, pos, email FROM mails WHERE {USABLE}"
FREE = "split_part(lower(email), '@', 2) IN ('gmail.com','naver.com','daum.net','hanmail.net','nate.com','outlook.com','hotmail.com','yahoo.com')"
SQL["company_emails"] = f"WITH {MAILS} SELECT doc_id, email FROM mails WHERE regexp_matches(lower(email), '@(.*\\.)?mail2\\.example\\.com$') OR {FREE}"
SQL["company_email"] = f"""WITH {MAILS}, c AS (SELECT *, trim(email, '<>()[],;: ·|/-–—：') AS e FROM mails WHERE {USABLE} AND regexp_matches(lower(email), '@(.*\\.)?example\\.com$')),
  s AS (SELECT *, 3 + CASE WHEN regexp_matches(lower(e), '^(info|contact|sales|help|support|master|admin|cs|mail|biz|business|office|hello|inquiry|webmaster|recruit)') THEN 2 ELSE 0 END AS score FROM c)
  SELECT source AS domain, e AS value, {URL_OF} AS source_url FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, pos) = 1"""
def _kw(k: str) -> str:
    return f"contains(h, '{k}')" if not k.isascii() else f"regexp_matches(h, '(^|[^a-z0-9]){k}([^a-z0-9]|$)')"
KWS = ("that", "thatin", "pour", "sich", "elle", "keit", "mente", "ción")
FOUND = "list_filter([" + ", ".join(f"CASE WHEN {_kw(k)} THEN '{k}' END" for k in KWS) + "], lambda x: x IS NOT NULL)"
SQL["company_industry"] = f"""WITH h AS (SELECT doc_id, source, lower(text) AS h FROM documents), f AS (SELECT *, {FOUND} AS fs FROM h),
  g AS (SELECT *, array_to_string(list_filter(fs, lambda k: len(list_filter(fs, lambda o: o <> k AND contains(o, k))) = 0), ', ') AS value FROM f WHERE len(fs) > 0)
  SELECT source AS domain, value, {URL_OF} AS source_url FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1"""
SQL["text_units"] = WITH_PAGES + f""", l AS (SELECT page_idx, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM pg),
  u AS (SELECT page_idx, list_concat(list_transform(ls, lambda x: {{'unit': x, 'joined': false}}), list_filter(list_transform(range(1, len(ls)), lambda i: CASE WHEN length(ls[i]) <= 20 AND length(ls[i + 1]) <= 20
    THEN {{'unit': ls[i] || ' ' || ls[i + 1], 'joined': true}} END), lambda x: x IS NOT NULL)) AS us FROM l),
  e AS (SELECT page_idx, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS unit_pos FROM u)
  SELECT page_idx, unit_pos, u.unit AS unit, u.joined AS joined FROM e"""
def _word(w: str) -> str:
    return f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({w})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"
SQL["title_rank"] = f"""SELECT doc_id, title_rank, ['Chief', 'Head', 'Lead'][title_rank + 1] AS title_group FROM (SELECT doc_id, CASE WHEN {_word('worthless|shehe')} THEN 0 WHEN {_word('sich|pour')} THEN 1
  WHEN {_word('that|elle')} THEN 2 END AS title_rank FROM documents)"""
SQL["it_jobs_only"] = WITH_LINKS + "SELECT from_idx, pos, anchor AS title FROM links WHERE regexp_matches(lower(anchor), '(^|[^a-z0-9])(the|der)([^a-z0-9]|$)|ción|für')"
def _any(words: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"
SQL["looks_like_posting"] = WITH_PAGES + f""", t AS (SELECT page_idx, title, lower(title) AS t FROM pg)
  SELECT page_idx, title FROM t WHERE length(title) <= 60 AND len(list_filter(regexp_split_to_array(title, '{WS}+'), lambda x: x <> '')) <= 8
  AND {_any('and')}::INT + {_any('of')}::INT + 2 * {_any('la')}::INT < 3 AND ({_any('the|que|von')} OR contains(t, 'ción'))"""
PARTS = """pj AS (SELECT p_brand AS domain, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 2 END AS phase, CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 2) ELSE p_name END AS title,
    p_partkey AS seq, p_size, p_type FROM part)"""
SQL["dedupe_jobs"] = f"""WITH {PARTS}, ok AS (SELECT * FROM pj a WHERE NOT (phase = 2 AND EXISTS (SELECT 1 FROM pj b WHERE b.domain = a.domain AND b.seq < a.seq AND contains(lower(a.title), lower(b.title)))))
  SELECT domain, title, seq FROM ok QUALIFY row_number() OVER (PARTITION BY domain, lower(title) ORDER BY seq) = 1"""
CTX = "title || ' contract 2026-05-' || phase || ' in Seoul today'"
SQL["job_fields"] = f"""WITH {PARTS} SELECT seq, CASE WHEN regexp_matches(title, '(^|[^a-z0-9])bolt([^a-z0-9]|$)') THEN 'Bolt' WHEN regexp_matches(title, '(^|[^a-z0-9])ring([^a-z0-9]|$)') THEN 'Ring'
  WHEN regexp_matches(title, '(^|[^a-z0-9])old widget([^a-z0-9]|$)') THEN 'Old Widget' END AS position, 'Seoul' AS location, 'Contract' AS employment_type, '2026-05-' || phase AS deadline, {CTX} AS description FROM pj"""
SQL["top_jobs"] = f"""WITH {PARTS} SELECT domain, place, seq FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN p_size > 10 THEN 0 ELSE 1 END,
  (p_size > 25)::INT + (p_size % 3 = 0)::INT DESC, seq) AS place FROM pj) WHERE place <= 10"""
TKW = ("Worthless", "Thatin", "Sich", "Mente", "Keit", "Pour")
SQL["tech_from_jobs"] = ("SELECT domain, array_to_string(list_filter([" + ", ".join(f"CASE WHEN k{i} THEN '{k}' END" for i, k in enumerate(TKW)) + "], lambda x: x IS NOT NULL)[1:3], '|') AS tech FROM (SELECT source AS domain, "
  + ", ".join(f"bool_or(regexp_matches(lang || ' ' || text, '(?i)(^|[^A-Za-z0-9]){k}([^A-Za-z0-9]|$)')) AS k{i}" for i, k in enumerate(TKW)) + " FROM documents GROUP BY 1)")

SQL["keep_first"] = "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"
SQL["merge_existing_keys"] = WITH_LEADS + """, k AS (SELECT email, lower(company_name) AS co, lower(contact_name) AS who FROM leads
  UNION SELECT email, lower(industry), lower('P' || id) FROM leads WHERE source = 'website' OR it_hiring = 'High')
  SELECT DISTINCT CASE WHEN email IS NULL THEN 'pair' ELSE 'email' END AS k_kind, coalesce(email, co) AS k1, CASE WHEN email IS NULL THEN who ELSE '' END AS k2 FROM k"""
SQL["import_anti_join"] = WITH_LEADS + """SELECT id, email FROM leads WHERE email IS NULL OR NOT (source = 'website' OR coalesce(it_hiring = 'High', false))"""
SQL["page_filter"] = """SELECT event_id, CAST(200 + floor(value) * 5 AS BIGINT) AS status FROM events WHERE 200 + floor(value) * 5 < 400 AND event_type <> 'click'"""
SQL["page_depths"] = WITH_LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT DISTINCT domain, from_idx, from_idx + pos * 3 AS to_idx FROM links),
  r AS (SELECT domain, page_idx AS node, 0::BIGINT AS d FROM pg WHERE home UNION SELECT e.domain, e.to_idx, d + 1 FROM r JOIN e ON e.domain = r.domain AND e.from_idx = r.node WHERE d < 100)
  SELECT page_idx, (SELECT min(d) FROM r WHERE r.domain = pg.domain AND r.node = pg.page_idx) AS link_depth FROM pg"""
SQL["deep_sitemaps"] = """SELECT 'x.kr' AS domain, 'https://x.kr/f' || s_nationkey || '.xml' AS sitemap_url, s_nationkey + 1 + (SELECT count(DISTINCT o.s_nationkey) FROM supplier o WHERE o.s_nationkey <= s.s_nationkey) AS file_no, 'https://x.kr/s/' || s_suppkey AS url FROM supplier s WHERE s_nationkey <= 20"""
SQL["deep_links"] = """WITH RECURSIVE p AS (SELECT 'n' || s_nationkey AS domain, s_suppkey AS page_idx, lead(s_suppkey) OVER w AS next, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS home FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
  e AS (SELECT domain, page_idx AS a, next AS b FROM p UNION SELECT domain, page_idx, page_idx + 50 FROM p UNION SELECT domain, page_idx, page_idx // 2 FROM p WHERE page_idx % 7 = 0),
  r AS (SELECT DISTINCT domain, home AS node, 0::BIGINT AS d FROM p UNION SELECT e.domain, e.b, d + 1 FROM r JOIN e ON e.domain = r.domain AND e.a = r.node WHERE d < 60)
  SELECT domain, page_idx, (SELECT min(d) FROM r WHERE r.domain = p.domain AND r.node = p.page_idx) AS link_depth FROM p"""
SQL["text_sources"] = WITH_PAGES + f""", l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM pg),
  f AS (SELECT page_idx, home, text, concat_ws(chr(10), nullif({FOOT}, ''), array_to_string(lines[CAST(floor(len(lines) * 0.75) AS BIGINT) + 1:], chr(10))) AS footer FROM l)
  SELECT 0 AS full, CASE WHEN home THEN 0 ELSE 1 END AS cat, page_idx AS idx, md5(footer) AS text FROM f WHERE footer <> ''
  UNION ALL SELECT 1, CASE WHEN home THEN 0 ELSE 1 END, page_idx, md5(text) FROM f WHERE text <> ''"""
def _first_part(t: str) -> str:
    p = f"list_filter(list_transform(regexp_split_to_array({_tidy(t)}, '\\s*[|·・\\-–—:]\\s*'), lambda p: {_tidy('p')}), lambda p: p <> '')"
    return f"CASE WHEN length(({p})[2]) > length(({p})[1]) THEN ({p})[2] ELSE ({p})[1] END"
HOLDER = _tidy("regexp_extract(text, '(?i)(?:©|ⓒ|copyright|copyrights)\\s*(?:\\(c\\)\\s*)?(?:\\d{4}\\s*(?:-\\s*\\d{4})?\\s*)?(?:by\\s+)?([^\\n.|©ⓒ]{2,60})', 1)")
SQL["company_name"] = WITH_PAGES + f""", c AS (SELECT domain, page_idx, url, {HOLDER} AS name, 4 AS score, 3 AS how, home FROM pg
    UNION ALL SELECT domain, page_idx, url, {_first_part('title')}, 3, 4, home FROM pg WHERE home),
  g AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY home DESC, page_idx, how) AS seq FROM c
    WHERE length(name) BETWEEN 2 AND 60 AND NOT (how = 3 AND (name LIKE '20%' OR name LIKE '19%'))
    AND NOT regexp_matches(name, '^[\\d\\s.,\\-]+$') AND lower(name) NOT IN ('home', 'index', 'main', 'company', 'site')),
  n AS (SELECT domain, name, max(score) AS score, min(seq) AS seq, first(url ORDER BY score DESC, seq) AS url FROM g GROUP BY 1, 2)
  SELECT domain, name AS value, url AS source_url FROM n QUALIFY row_number() OVER (PARTITION BY domain ORDER BY
    score + CASE WHEN contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'example') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(lower(name), 'co\\., ltd|co\\.,ltd|inc\\.|corp\\.|ltd\\.') THEN 2 ELSE 0 END DESC, length(name), n.seq) = 1"""
SQL["cf_email"] = """WITH t AS (SELECT doc_id, unnest(hs) AS h, unnest(range(0, len(hs))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, 'token = "([0-9a-f]{40})', 1) AS hs FROM documents)),
  b AS (SELECT doc_id, pos, list_transform(range(0, 20), lambda i: CAST('0x' || h[i * 2 + 1:i * 2 + 2] AS INT)) AS b FROM t),
  e AS (SELECT doc_id, pos, array_to_string(list_transform(b[2:], lambda x: chr(xor(x, b[1]))), '') AS e FROM b)
  SELECT doc_id, pos, length(e) AS chars, md5(e) AS email FROM e"""
SQL["plausible_names"] = """SELECT doc_id, pos, name FROM (SELECT doc_id, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS pos FROM (
    SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z]?[a-z]+') AS w FROM documents)) WHERE regexp_matches(name, '^[A-Z][a-z]{1,15} [A-Z][a-z]{1,15}$')"""
SQL["excluded_roles"] = """SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(lower(text), 'cfo|cmo|chro|hr|sales|marketing|finance|accounting|legal|procurement')
  OR regexp_matches(lower(text), '\\b(cto|cio|cpo|ceo|founder)\\b')"""
SQL["in_country"] = "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1') OR contains(lower(n_name), 'korea')"
def _hit(words: str, t: str) -> str:
    return f"regexp_matches(lower({t}), '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"
SQL["job_candidates"] = WITH_LINKS + f""", c AS (SELECT from_idx AS page_idx, 1 AS phase, {_tidy('anchor')} AS title FROM links
    UNION ALL SELECT page_idx, 2, {_tidy(_text("unnest(regexp_extract_all(html, '<h1>(.*?)</h1>', 1))"))} FROM pg)
  SELECT page_idx, phase, title FROM c WHERE length(title) BETWEEN 4 AND 60 AND len(string_split(title, ' ')) <= 8 AND ({_hit('the|que|der|und|that', 'title')} OR contains(lower(title), 'ción'))
  AND {_hit('and', 'title')}::INT + {_hit('of', 'title')}::INT + {_hit('la', 'title')}::INT < 3"""
SQL["delete_activities"] = "SELECT conv_id * 1000 + turn AS id, CASE role WHEN 'user' THEN 'Call' ELSE 'email' END AS type FROM conversations WHERE role IN ('user', 'assistant')"

# --- customer sites and uploads --------------------------------------------------------------

SITE = """site AS (SELECT c_custkey AS key, replace(lower(c_name), '#', '-') || '.co.kr' AS domain, c_name, c_nationkey % 3 AS m,
    ['박민호','이서연','최지훈','정다은','강현우','윤서진','한지민'][c_custkey % 7 + 1] AS ceo, printf('%03d-%02d-%05d', c_custkey % 900 + 100, c_custkey % 90 + 10, c_custkey % 100000) AS biz,
    '서울특별시 강남구 테헤란로 ' || (c_custkey % 500 + 1) AS address, '02-' || printf('%04d', c_custkey % 9000 + 1000) || '-5678' AS phone,
    'https://' || replace(lower(c_name), '#', '-') || '.co.kr/' AS home FROM customer)"""
OPENINGS = """kinds AS (SELECT DISTINCT o_custkey AS key, CAST(o_orderpriority[1] AS INT) AS k FROM orders),
  openings AS (SELECT s.key, k, CASE k WHEN 1 THEN '자바 개발자 모집' WHEN 2 THEN '데이터 엔지니어 채용' ELSE '백엔드 개발자 채용' END AS title,
    CASE k WHEN 2 THEN '데이터' ELSE '개발자' END AS position, home || 'recruit/' || k AS link FROM kinds JOIN site s USING (key) WHERE k IN (1, 2, 4)),
  jobs AS (SELECT key, count(*) AS n, string_agg(title, ', ' ORDER BY k) AS titles, string_agg('{"title":"' || title || '","position":"' || position
    || '","location":null,"employment_type":"정규직","deadline":null,"description":null,"source_url":"' || link || '"}', ',' ORDER BY k) AS j FROM openings GROUP BY key)"""
SIGNAL = "CASE WHEN n >= 5 THEN 'High' WHEN n >= 2 THEN 'Medium' WHEN n >= 1 THEN 'Low' ELSE 'None' END"
SQL["company_address"] = f"WITH {SITE} SELECT domain, address AS value, home AS source_url FROM site"
SQL["company_biz_number"] = f"WITH {SITE} SELECT domain, biz AS value, home AS source_url FROM site"
SQL["company_ceo"] = f"WITH {SITE} SELECT domain, ceo AS value, home AS source_url FROM site"
SQL["email_hint"] = f"WITH {SITE} SELECT domain, CASE m WHEN 1 THEN 'image' ELSE 'form' END AS type, home AS url FROM site WHERE m > 0"
SQL["page_priority"] = "SELECT c_custkey * 2 + i AS page_idx, CAST(2 + i AS BIGINT) AS place, c_custkey * 2 + i AS idx FROM customer, (SELECT unnest([0, 1]) AS i)"
SQL["footer_coverage"] = f"WITH {SITE} SELECT domain, category FROM site, (SELECT unnest(['company', 'contact']) AS category) WHERE m = 0"
SQL["contact_candidates"] = f"WITH {SITE} SELECT domain, ceo AS name, CAST(7 AS BIGINT) AS title_rank, '대표이사' AS position, home AS source_url FROM site"
SQL["key_contacts"] = """WITH RECURSIVE c AS (SELECT 'n' || c_nationkey AS domain, 'Kim ' || (c_custkey % 40) AS name, c_custkey % 5 AS r, c_custkey AS seq FROM customer),
  p AS (SELECT domain, name, min(r) AS r, min(seq) AS first FROM c GROUP BY 1, 2),
  l AS (SELECT domain, list({'name': name, 'r': r} ORDER BY r, first, name) AS ps FROM p GROUP BY 1),
  w AS (SELECT domain, ps, 1 AS i, CAST([] AS STRUCT(name VARCHAR, r BIGINT)[]) AS kept FROM l
    UNION ALL SELECT domain, ps, i + 1, CASE WHEN len(list_filter(kept, lambda q: contains(lower(q.name), lower(ps[i].name)) OR contains(lower(ps[i].name), lower(q.name)))) > 0 THEN kept ELSE list_append(kept, ps[i]) END
    FROM w WHERE i <= len(ps))
  SELECT domain, place, kept[place].name AS name, 'p' || kept[place].r AS position, CAST(kept[place].r AS BIGINT) AS title_rank
  FROM (SELECT domain, kept, unnest(generate_series(1, len(kept))) AS place FROM w WHERE i = len(ps) + 1)"""
SQL["name_variants"] = """WITH RECURSIVE p AS (SELECT 'n' || c_nationkey AS domain, 'lee ' || right((c_custkey * 7919 % 100003)::VARCHAR, (c_custkey % 4 + 1)::INT) AS name, c_custkey % 7 AS r, c_custkey AS seq, c_custkey % 3 = 0 AS big FROM customer),
  e AS (SELECT domain, name, min(r) AS r, min(seq) AS seq FROM p GROUP BY domain, name, big),
  b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY domain, name ORDER BY r, seq) = 1),
  o AS (SELECT domain, name, r, row_number() OVER (PARTITION BY domain ORDER BY r, seq) AS i FROM b),
  w AS (SELECT domain, list(struct_pack(name := name, r := r) ORDER BY i) AS ps, 1 AS i, []::STRUCT(name VARCHAR, r BIGINT)[] AS kept FROM o GROUP BY domain
    UNION ALL SELECT domain, ps, i + 1, CASE WHEN len(list_filter(kept, lambda q: contains(q.name, ps[i].name) OR contains(ps[i].name, q.name))) > 0 THEN kept ELSE list_append(kept, ps[i]) END FROM w WHERE i <= len(ps))
  SELECT domain, place, kept[place].name AS name, kept[place].r AS title_rank FROM (SELECT domain, kept, unnest(generate_series(1, len(kept))) AS place FROM w WHERE i = len(ps) + 1)"""
SQL["scan_result"] = f"""WITH {SITE}, {OPENINGS} SELECT domain, c_name AS name, address, phone, CASE m WHEN 0 THEN 'info@' || domain END AS email, 'software' AS industry, biz AS biz_number, ceo,
  home AS website, home AS name_source, CASE m WHEN 1 THEN '{{"email":{{"type":"image","url":"' || home || '"}}}}' WHEN 2 THEN '{{"email":{{"type":"form","url":"' || home || '"}}}}' END AS company_hints,
  '[{{"name":"' || ceo || '","position":"대표이사","source_url":"' || home || '"}}]' AS key_contacts, '[' || coalesce(j, '') || ']' AS it_recruitment,
  {SIGNAL} AS it_hiring, home || ' ' || home || 'recruit' AS sources, home AS scanned_url, CAST(2 AS BIGINT) AS pages_crawled FROM site LEFT JOIN jobs USING (key)"""
SQL["leads_from_scans"] = f"""WITH {SITE}, {OPENINGS} SELECT key + 1 AS row, domain, c_name AS company_name, ceo AS contact_name, '대표이사' AS rank, phone, CASE m WHEN 0 THEN 'info@' || domain END AS email,
  {SIGNAL} AS it_hiring, '주소: ' || address || coalesce(chr(10) || '채용: ' || titles, '') AS memo FROM site LEFT JOIN jobs USING (key)"""
SQL["decode_pages"] = """WITH t AS (SELECT page_id, CASE WHEN page_id % 2 = 1 THEN regexp_replace(html, '[^\\x{00}-\\x{ff}]', '?', 'g') ELSE html END AS html FROM pages)
  SELECT page_id, length(html) AS chars, md5(html) AS html FROM t"""
UPLOAD = "upload AS (SELECT 'f' || c_nationkey || '_' || (c_custkey // 10000) AS file, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 10000 ORDER BY c_custkey) AS row, c_name, CAST(floor(c_acctbal) AS BIGINT)::VARCHAR AS budget FROM customer)"
SQL["read_leads_csv"] = f"WITH {UPLOAD} SELECT file, row, 'Co, ' || c_name AS company, budget FROM upload"
SQL["read_split_csv"] = """SELECT 'f' || c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row, 'Co; ' || c_name || ' "A"' || chr(13) || chr(10) || 'of ' || c_mktsegment AS company,
  CAST(floor(c_acctbal) AS BIGINT)::VARCHAR AS budget FROM customer"""
SQL["decode_korean"] = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '우리회사 대표이사 홍길동 ' ELSE 'Café für ' END || c_name AS html FROM customer"
SQL["read_leads_json"] = f"""WITH {UPLOAD} SELECT file, row, '"Co, ' || c_name || '"' AS company, NULL::VARCHAR AS code FROM upload WHERE NOT starts_with(file, 'f3_')
  UNION ALL SELECT DISTINCT file, NULL::BIGINT, NULL::VARCHAR, 'file_invalid' FROM upload WHERE starts_with(file, 'f3_')"""
SQL["read_sitemaps"] = "SELECT 'x.kr' AS domain, 'https://x.kr/n' || s_nationkey || '.xml' AS sitemap_url, 'https://x.kr/s/' || s_suppkey AS url FROM supplier"
SQL["import_leads"] = WITH_IMPORT + """, q AS (SELECT k.*, coalesce(bad, false) AS no, CASE WHEN row % 2 = 0 THEN 'a.csv' ELSE 'b.csv' END AS file, row // 2 + 1 AS r FROM keyed k),
  z AS (SELECT q.*, row_number() OVER (PARTITION BY key ORDER BY no, file, r) AS nth FROM q),
  b AS (SELECT file, coalesce(sum(m) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT file, max(r) AS m FROM q GROUP BY 1)),
  x AS (SELECT max(id) AS top FROM leads WHERE source = 'website' OR it_hiring = 'High')
  SELECT CAST(top + before + r AS BIGINT) AS id, z.company_name, z.contact_name, lower(z.email) AS email, 'meeting' AS status, l.budget
  FROM z JOIN b USING (file), x, rawl l WHERE l.id = z.row AND NOT no AND nth = 1 AND key NOT IN (SELECT key FROM old)"""
SQL["norm_mobile"] = WITH_LEADS + "SELECT id AS row, mobile, phone FROM rawl"
KEYS = """k AS (SELECT id, unnest([domain, lower(email), lower(company_name)]) AS key, unnest(['domain', 'email', 'name']) AS reason FROM leads),
  p AS (SELECT id AS probe_id, unnest([domain, CASE WHEN b % 5 = 0 THEN 'not-an-email' ELSE email END, lower(company_name)]) AS key, unnest(['domain', 'email', 'name']) AS reason FROM rawl)"""
SQL["find_duplicate_leads"] = WITH_LEADS + f", {KEYS} SELECT probe_id, reason, key FROM p WHERE key IS NOT NULL AND (reason, key) IN (SELECT (reason, key) FROM k WHERE key IS NOT NULL)"
SQL["duplicate_lead_keys"] = WITH_LEADS + f", {KEYS} SELECT id, reason, key FROM k WHERE key IS NOT NULL AND (reason, key) IN (SELECT (reason, key) FROM p WHERE key IS NOT NULL)"
SQL["write_leads_refused"] = WITH_LEADS + "SELECT id, 'company_required' AS code, company_name, memo FROM leads WHERE status = 'won'"

# --- nested pages: every tag compared with every other tag of its page ------------------------------

_NEST = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate((
    '<div>{seg} 정규직<div><p>부서 {key}</p></div><a href="/jobs/{key}">{one}</a><div>마감일: 2026-05-01</div></div>',
    "<ul><li><h3>{one}</h3> 정규직 {key}<ul><li>서울</li></ul><li>{two} 계약직</ul>",
    "<table><tr><td>{one}<td>정규직 {key}<tr><td><table><tr><td>{two}</td></tr></table> 인턴</table>",
    "</div></li><article>{seg} 정규직 <h2>{one}</h2> {key}",
    "<div><article><strong>{one}</strong> 정규직</div>{key} <strong>{two}</strong></article> 계약직",
    '<div class="a"><div class="b"><ol><li><strong>{one}</strong><li><a href="/recruit/{key}">{two}</a> 정규직</ol></div>{seg}</div>')))
_FEET = '<div class="my-footer"><div>{seg}</div><footer>in {key}</footer>x</div><footer>a<footer>b</footer>{one}</footer><p>more</p><address>{key}'
_KINDS = "['자바 개발자 모집','데이터 엔지니어 채용','영업사원 모집','백엔드 개발자 채용','총무 담당자 채용']"
NESTED = f"""np AS (SELECT c_custkey AS page_idx, 'https://c' || c_custkey || '.co.kr/' AS site, replace(replace(replace(replace('<html><body>' || CASE c_custkey % 6 {_NEST} END || '{_FEET}',
    '{{seg}}', upper(c_mktsegment[1]) || lower(c_mktsegment[2:])), '{{key}}', c_custkey::VARCHAR), '{{one}}', {_KINDS}[c_custkey % 5 + 1]), '{{two}}', {_KINDS}[(c_custkey // 5) % 5 + 1]) AS html FROM customer)"""
_TAG = r"(?is)</?(?:a|h1|h2|h3|h4|li|td|strong|tr|article|div|ul|ol|menu|table|th)(?:[\s/][^>]*)?>"
SQL["nested_openings"] = f"""WITH {NESTED}, cut AS (SELECT *, regexp_extract_all(html, '{_TAG}') AS tags, string_split_regex(html, '{_TAG}') AS pieces FROM np),
  tag AS (SELECT page_idx, i, len(tags) + 1 AS last, lower(regexp_extract(tags[i], '^</?([A-Za-z0-9]+)', 1)) AS name, starts_with(tags[i], '</') AS shut
          FROM (SELECT *, unnest(generate_series(1, len(tags))) AS i FROM cut)),
  kind AS (SELECT *, CASE WHEN name IN ('ul', 'ol', 'menu', 'li') THEN 'list' WHEN name IN ('table', 'tr', 'td', 'th') THEN 'table' ELSE name END AS family, name IN ('li', 'tr', 'td', 'th', 'a') AS item FROM tag),
  -- an end tag closes a start tag if all between them pair up
  pairs AS (SELECT o.page_idx, o.i, c.i AS j FROM kind o JOIN kind c ON c.page_idx = o.page_idx AND c.family = o.family AND c.i > o.i AND c.shut AND NOT o.shut AND NOT o.item AND NOT c.item),
  depth AS (SELECT p.page_idx, p.i, p.j, sum(CASE WHEN m.shut THEN -1 WHEN m.shut IS NULL THEN 0 ELSE 1 END) AS d FROM pairs p JOIN kind o ON o.page_idx = p.page_idx AND o.i = p.i
            LEFT JOIN kind m ON m.page_idx = p.page_idx AND m.family = o.family AND NOT m.item AND m.i > p.i AND m.i < p.j GROUP BY ALL),
  plain AS (SELECT k.page_idx, k.name, k.family, k.i, coalesce((SELECT min(j) FROM depth d WHERE d.page_idx = k.page_idx AND d.i = k.i AND d.d = 0), k.last) AS e FROM kind k WHERE NOT k.shut AND NOT k.item),
  scoped AS (SELECT k.*, coalesce((SELECT max(p.i) FROM plain p WHERE p.page_idx = k.page_idx AND p.family = k.family AND p.i < k.i AND p.e > k.i), 0) AS scope FROM kind k WHERE k.item),
  items AS (SELECT s.page_idx, s.name, s.family, s.i, least(s.last, coalesce((SELECT min(t.i) FROM scoped t WHERE t.page_idx = s.page_idx AND t.family = s.family AND t.scope = s.scope AND t.i > s.i
              AND (s.name <> 'tr' OR t.name = 'tr')), s.last), coalesce((SELECT p.e FROM plain p WHERE p.page_idx = s.page_idx AND p.i = s.scope), s.last)) AS e FROM scoped s WHERE NOT s.shut),
  el AS (SELECT * FROM plain UNION ALL SELECT * FROM items),
  boxed AS (SELECT x.page_idx, x.name, x.i, x.e, (SELECT max(struct_pack(i := b.i, e := b.e)) FROM el b WHERE b.page_idx = x.page_idx AND b.name IN ('li', 'tr', 'article', 'div') AND b.i < x.i AND b.e > x.i) AS box
            FROM el x WHERE x.name IN ('a', 'h1', 'h2', 'h3', 'h4', 'li', 'td', 'strong')),
  said AS (SELECT b.*, site, array_to_string(list_transform(generate_series(b.i, b.e - 1), lambda k: tags[k] || pieces[k + 1]), '') AS own,
             array_to_string(list_transform(generate_series(b.box.i, b.box.e - 1), lambda k: tags[k] || pieces[k + 1]), '') AS around FROM boxed b JOIN cut USING (page_idx)),
  txt AS (SELECT page_idx, CASE WHEN name = 'a' THEN 1 ELSE 2 END AS phase, i AS pos, replace({_text('own')}, chr(10), ' ') AS t, replace({_text('around')}, chr(10), ' ') AS c, site, contains(own, '<a href=') AS linked, regexp_extract(own, 'href="/([^"]*)"', 1) AS path FROM said)
  SELECT page_idx, phase, pos, {_tidy('t')} AS title, coalesce({_tidy('c')}, {_tidy('t')}) AS context, site || CASE WHEN phase = 1 THEN path ELSE 'recruit' END AS source_url
  FROM txt WHERE linked = (phase = 1) AND regexp_matches(t, '개발|데이터|엔지니어|백엔드') AND length({_tidy('t')}) BETWEEN 4 AND 60 AND len(string_split({_tidy('t')}, ' ')) <= 8"""
SQL["nested_footers"] = f"""WITH {NESTED} SELECT page_idx, pos, replace(replace(replace(CASE pos WHEN 0 THEN 'a b ' || regexp_extract(html, '</footer>([^<]*)</footer>', 1) WHEN 1 THEN regexp_extract(html, 'my-footer"><div>([^<]*)<', 1) || ' in ' || page_idx || ' x'
    ELSE page_idx::VARCHAR END, '&', '&'), chr(10), ' '), '  ', ' ') AS text FROM np, (SELECT unnest([0, 1, 2]) AS pos)"""

# --- streams ---------------------------------------------------------------------------------------

DELTAS = WITH_TREND + """, newest AS (SELECT domain, id, it_jobs, lead(it_jobs) OVER w AS prev_it_jobs, row_number() OVER w AS n FROM scans WINDOW w AS (PARTITION BY domain ORDER BY scanned_at DESC, id DESC))"""
SQL["stream_jobs_delta"] = DELTAS + " SELECT domain, id, it_jobs, prev_it_jobs, it_jobs - prev_it_jobs AS jobs_delta FROM newest WHERE n = 1"
SQL["stream_rising_alerts"] = DELTAS + " SELECT domain, id, 1::BIGINT AS alerts FROM newest WHERE n = 1 AND it_jobs > prev_it_jobs"
SQL["stream_stage_state"] = WITH_HIST + """SELECT lead_id, to_status AS status FROM hist QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY "at" DESC, id DESC) = 1"""
SQL["stream_dedupe"] = "SELECT source AS domain, count(DISTINCT CASE WHEN coalesce(text, '') <> '' THEN text ELSE 'page ' || doc_id END) AS pages FROM documents GROUP BY 1"
