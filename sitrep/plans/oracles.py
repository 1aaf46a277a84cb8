"""The registered queries once more, in SQL another engine can run on the same tables.

Written from the meaning of each operator, not from its Spark plan.
"""

from __future__ import annotations

from sitrep import constants as K
from sitrep.functions.text import EMOJI, KEYCAP, SPACE, WORD
from sitrep.plans import proxies as X
from sitrep.plans.queries import ALERT_NOW, UNSUBSCRIBE


def lit(v: object) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def within(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def rows(values) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in values)


def pick(values, index: str) -> str:
    return f"{array(values)}[CAST({index} AS INTEGER) + 1]"


def lat(key: str) -> str:
    return f"(-0.5e0 + CAST(({key} * 37) % 900 AS DOUBLE) / 100e0)"


def lon(key: str) -> str:
    return f"(98.5e0 + CAST(({key} * 53) % 2200 AS DOUBLE) / 100e0)"


def alternation(terms) -> str:
    return "|".join(sorted(set(terms), key=lambda t: (-len(t), t)))


def found(text: str, terms, prefix: bool = False) -> str:
    """All terms in a text. Separators are doubled because this dialect has no look-around, so
    that one can end a term and the other start the next."""
    if prefix:
        return f"regexp_extract_all(lower({text}), '(?:^|[^{WORD}])({alternation(terms)})', 1)"
    doubled = []
    for t in alternation(terms).split("|"):
        doubled.append("".join(ch if ch.isalnum() or ch == "_" else ch + ch for ch in t))
    names = "|".join(doubled)
    return (
        f"list_transform(regexp_extract_all(regexp_replace(lower({text}), '([^{WORD}])', '\\1\\1', 'g'), "
        f"'(?:^|[^{WORD}])({names})(?:$|[^{WORD}])', 1), "
        f"lambda m: regexp_replace(m, '([^{WORD}])[^{WORD}]', '\\1', 'g'))"
    )


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'), ' ')"


# --- views ----------------------------------------------------------------------------------
POSTS = f"""posts AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id,
    CASE event_type WHEN 'click' THEN 'flood' WHEN 'view' THEN 'storm'
      WHEN 'purchase' THEN 'landslide' WHEN 'signup' THEN 'haze' ELSE 'none' END AS disaster_type,
    ts AS start_time, n_name AS state,
    CASE WHEN user_id % 12 = 0 THEN 'Unknown District'
      ELSE 'District ' || CAST(user_id AS VARCHAR) END AS district,
    CASE WHEN value >= 2 THEN {lon('event_id')} END AS lon,
    CASE WHEN value >= 2 THEN {lat('event_id')} END AS lat,
    CAST(json_extract(props, '$.k') AS INTEGER) AS k, value,
    CASE WHEN value >= 10 THEN CASE WHEN value < 60 THEN 'Informational'
      WHEN value < 150 THEN 'Warning' ELSE 'Urgent' END END AS label
  FROM events JOIN nation ON n_nationkey = user_id % 25),
texts AS (
  SELECT *, 'Report ' || post_id || ' level ' || CAST(k AS VARCHAR) AS post_text,
    CASE WHEN k < 5 THEN 'null'
      ELSE disaster_type || ', Topic ' || CAST(k % 17 AS VARCHAR) || ', ,Rain' END AS keywords,
    CASE WHEN k < 10 THEN 'null'
      ELSE '#Tag' || CAST(k % 23 AS VARCHAR) || ', #Help' END AS hashtags
  FROM posts)"""

EVENTS = f"""ev AS (
  SELECT 'EV-' || CAST(o_orderkey AS VARCHAR) AS event_id,
    {pick(X.TYPES, f'(o_orderkey * 7 + o_custkey) % {len(X.TYPES)}')} AS classification_type,
    {pick([d for _, d in X.PAIRS], f'o_custkey % {len(X.PAIRS)}')} AS location_district,
    {pick([s for s, _ in X.PAIRS], f'o_custkey % {len(X.PAIRS)}')} AS location_state,
    o_orderdate + to_hours(o_orderkey % 24) AS start_time,
    o_orderdate + to_hours(o_orderkey % 24) + to_hours(o_custkey % 72) AS most_recent_report,
    CASE WHEN o_totalprice >= 5000 THEN {lon('o_orderkey')} END AS lon,
    CASE WHEN o_totalprice >= 15000 THEN {lat('o_orderkey')} END AS lat,
    CAST(o_custkey % 5 + 1 AS BIGINT) AS total_posts_count,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_hours(o_orderkey % 24)
      + to_hours(o_custkey % 72) + INTERVAL 80 DAY END AS last_alert_sent,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1440 END AS alert_cooldown_mins
  FROM orders)"""

FLAT = """event_id, classification_type, location_district, location_state, start_time,
  most_recent_report, lon, lat, total_posts_count"""

DOCS = f"""docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS post_id,
    text || ' ' || {pick(X.PHRASES, f'doc_id % {len(X.PHRASES)}')} AS post_text,
    CASE WHEN n_chars >= 100 THEN {lat('doc_id')} END AS latitude,
    CASE WHEN n_chars >= 100 THEN {lon('doc_id')} END AS longitude
  FROM documents)"""

CHECKS = """checks AS (
  SELECT 'C' || CAST(doc_id AS VARCHAR) AS check_id, CAST(doc_id AS VARCHAR) AS post_id,
    CASE WHEN toxic = 1 THEN 'MISINFORMATION' WHEN quality = 1 THEN 'AUTHENTIC'
      ELSE 'UNCERTAIN' END AS check_label
  FROM labels)"""

_N = len(X.SUBSCRIBER_STATES)
SUBS = f"""subs AS (
  SELECT lower(replace(c_name, '#', '.')) || '@example.com' AS email,
    list_distinct([{pick(X.SUBSCRIBER_STATES, f'c_nationkey % {_N}')},
      {pick(X.SUBSCRIBER_STATES, f'(c_nationkey + 7) % {_N}')}]) AS locations,
    {pick(X.SUBSCRIBER_STATES, f'c_nationkey % {_N}')} AS first_location,
    {pick(X.SUBSCRIBER_STATES, f'(c_nationkey + 7) % {_N}')} AS second_location,
    c_acctbal, c_mktsegment
  FROM customer)"""

STATES = f"""states(alias, display) AS (VALUES {rows({**K.STATE_DISPLAY, **K.STATE_DISPLAY_EXTRA}.items())})"""
GAZETTEER = f"""gaz(name, state, district) AS (VALUES {rows(K.gazetteer_rows())})"""

POLYGONS = f"""boxes AS (
  SELECT CAST(n_nationkey AS BIGINT) AS polygon_id,
    99.005e0 + CAST(n_nationkey % 5 AS DOUBLE) * 4.2e0 AS x0,
    0.005e0 + CAST((n_nationkey - n_nationkey % 5) / 5 AS DOUBLE) * 1.6e0 AS y0,
    {pick([s for s, _ in X.PAIRS], 'n_nationkey * 4')} AS state,
    {pick([d for _, d in X.PAIRS], 'n_nationkey * 4')} AS district
  FROM nation),
corners AS (SELECT *, x0 + 4.5e0 AS x1, y0 + 1.8e0 AS y1 FROM boxes),
edges(polygon_id, ax, ay, zx, zy) AS (
  SELECT polygon_id, x0, y0, x1, y0 FROM corners
  UNION ALL SELECT polygon_id, x1, y0, x1, y1 FROM corners WHERE polygon_id % 2 = 0
  UNION ALL SELECT polygon_id, x1, y1, x0, y1 FROM corners WHERE polygon_id % 2 = 0
  UNION ALL SELECT polygon_id, x0, y1, x0, y0 FROM corners WHERE polygon_id % 2 = 0
  UNION ALL SELECT polygon_id, x1, y0, (x0 + x1) / 2, y1 FROM corners WHERE polygon_id % 2 = 1
  UNION ALL SELECT polygon_id, (x0 + x1) / 2, y1, x0, y0 FROM corners WHERE polygon_id % 2 = 1)"""


def hits(points: str) -> str:
    """Lowest polygon containing each point of ``points(post_id, lat, lon)``, by parity."""
    return f"""usable AS (
  SELECT * FROM {points} WHERE lat BETWEEN {K.LAT_MIN} AND {K.LAT_MAX}
    AND lon BETWEEN {K.LON_MIN} AND {K.LON_MAX}),
crossed AS (
  SELECT post_id, polygon_id, count(*) AS n FROM usable JOIN edges ON (ay > lat) <> (zy > lat)
  WHERE lon < (zx - ax) * (lat - ay) / (zy - ay) + ax GROUP BY ALL),
hits AS (SELECT post_id, min(polygon_id) AS polygon_id FROM crossed WHERE n % 2 = 1 GROUP BY 1)"""


def sessions(source: str) -> str:
    return f"""keyed AS (SELECT post_id, disaster_type, lower(district) AS d, lower(state) AS s,
    start_time, coalesce(lon, 0) AS lon, coalesce(lat, 0) AS lat FROM {source}),
gaps AS (SELECT *, lag(start_time) OVER (PARTITION BY disaster_type, d
    ORDER BY start_time, post_id) AS p FROM keyed),
numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR start_time > p + INTERVAL 24 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY disaster_type, d ORDER BY start_time, post_id
      ROWS UNBOUNDED PRECEDING) AS sid FROM gaps),
firsts AS (SELECT *, first_value(post_id) OVER (PARTITION BY disaster_type, d, sid
    ORDER BY start_time, post_id) AS first_id, min(start_time) OVER (PARTITION BY disaster_type, d, sid)
    AS first_at FROM numbered),
members AS (SELECT *, upper(disaster_type) || '-' || upper(replace(d, ' ', '')) || '-'
    || strftime(first_at, '%Y%m%d-%H%M%S') || '-' || substr(md5(first_id), 1, 4) AS event_id
    FROM firsts)"""


CONSOLIDATED = """SELECT event_id, disaster_type AS classification_type, d AS location_district,
  arg_max(s, (start_time, post_id)) AS location_state, min(start_time) AS start_time,
  max(start_time) AS most_recent_report, arg_min(lon, (start_time, post_id)) AS lon,
  arg_min(lat, (start_time, post_id)) AS lat, count(DISTINCT post_id) AS total_posts_count
FROM members GROUP BY event_id, disaster_type, d"""

HOT = f"""{POSTS}, hot AS (SELECT * REPLACE ('Zone ' || CAST(CAST(post_id AS BIGINT) % 12 AS VARCHAR)
  AS district) FROM posts)"""

TOPICS = r"""part_topics AS (
  SELECT trim(regexp_replace(lower(p_name || '!'), '[^a-z0-9_ ]', '', 'g')) AS topic
  FROM part WHERE p_size > 3),
mapping AS (SELECT DISTINCT p_name AS topic, 'Group ' || split_part(p_name, ' ', 1) AS canonical
  FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'blue')),
topic_n AS (SELECT coalesce(canonical, p.topic) AS term, count(*) AS frequency
  FROM part_topics p LEFT JOIN mapping m ON m.topic = p.topic GROUP BY 1),
tag_n AS (SELECT replace(lower(trim(tag)), '#', '') AS term, count(*) AS frequency
  FROM (SELECT unnest(split('#' || p_brand || ', #' || p_type, ',')) AS tag FROM part) GROUP BY 1),
tracking AS (SELECT term, 'keyword' AS type, frequency FROM topic_n
  UNION ALL SELECT '#' || term, 'hashtag', frequency FROM tag_n)"""

UNKNOWN = within(K.UNKNOWN_TERMS)
VALID = "lon IS NOT NULL AND lat IS NOT NULL"
DUE = f"""due AS (SELECT * FROM ev WHERE start_time >= TIMESTAMP '{ALERT_NOW}' - INTERVAL 90 DAY
  AND year(start_time) >= year(TIMESTAMP '{ALERT_NOW}') - 1 AND coalesce(location_state, '') <> ''
  AND (last_alert_sent IS NULL OR last_alert_sent
    + to_minutes(CAST(coalesce(alert_cooldown_mins, 60) AS BIGINT)) <= TIMESTAMP '{ALERT_NOW}'))"""
SUBSCRIBED = f"""subscribed AS (SELECT DISTINCT email, lower(coalesce(display, l)) AS state FROM (
    SELECT email, first_location AS l FROM subs UNION ALL SELECT email, second_location FROM subs)
  LEFT JOIN states ON alias = lower(l))"""
LOCATED = f"""located AS (
  SELECT CAST(doc_id AS VARCHAR) AS post_id, text, lang, source, n_chars,
    CASE WHEN n_chars < 50 THEN NULL ELSE n_chars >= 200 END AS geo_processed,
    n_chars >= 100 AS has_geo,
    CASE WHEN n_chars >= 100 THEN CASE WHEN n_chars % 7 = 0 THEN 'Unknown State' ELSE lang END END AS state,
    CASE WHEN n_chars >= 100 THEN {lon('doc_id')} END AS lon,
    CASE WHEN n_chars >= 100 THEN CAST(n_chars % 11 AS DOUBLE) / 10e0 END AS confidence_score,
    CASE n_chars % 3 WHEN 0 THEN 'old topic' WHEN 1 THEN 'null' END AS keywords,
    n_chars % 5 = 0 AS keywords_generated,
    make_timestamp((1700000000 + doc_id * 60) * 1000000) AS created
  FROM documents),
incident AS (
  SELECT post_id, min(t) AS classification_type FROM (
    SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE WHEN quality = 1 THEN 'flood' ELSE 'storm' END AS t FROM labels
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'earthquake' FROM labels WHERE toxic = 1
    UNION ALL SELECT 'lost-' || CAST(doc_id AS VARCHAR), 'haze' FROM labels WHERE quality = 0)
  GROUP BY 1),
severity AS (
  SELECT post_id, label, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY label, confidence) AS rn FROM (
      SELECT CAST(conv_id AS VARCHAR) AS post_id, CAST(turn AS DOUBLE) / 10e0 AS confidence,
        CASE WHEN length(text) < 200 THEN 'Informational' WHEN length(text) < 400 THEN 'Warning'
          ELSE 'Urgent' END AS label FROM conversations)) WHERE rn = 1)"""

NONE_PLACE = "lower(trim({c})) IN ('null', '', 'none', 'nan', 'unknown') OR starts_with(lower(trim({c})), 'unknown ')"


def missing(c: str) -> str:
    return f"CASE WHEN NOT ({NONE_PLACE.format(c=c)}) THEN {c} END AS {c}"


def ranking(source: str, unknown) -> str:
    return f"""SELECT location_district AS district, count(*) AS event_count FROM {source}
WHERE location_district IS NOT NULL AND location_district NOT IN {within(unknown)}
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


def facets(kept: str, typed: str, unknown, severity: str) -> str:
    return f"""SELECT 'type_counts' AS facet, classification_type AS key, CAST(NULL AS INTEGER) AS year,
  CAST(NULL AS INTEGER) AS month, count(*) AS frequency FROM {kept} WHERE {typed} GROUP BY 2
UNION ALL SELECT 'district_ranking', district, NULL, NULL, event_count FROM ({ranking(kept, unknown)})
UNION ALL SELECT 'monthly_events', NULL, CAST(year(start_time) AS INTEGER),
  CAST(month(start_time) AS INTEGER), count(*) FROM {kept} GROUP BY 3, 4
UNION ALL SELECT 'sentiment_counts', label, NULL, NULL, count(*) FROM {severity} GROUP BY 2"""


ALL_TIME = f"""alltime AS (SELECT * FROM ev WHERE location_district IS NOT NULL
  AND location_district NOT IN {within(K.RANKING_UNKNOWN)}
  AND classification_type IS DISTINCT FROM 'none')"""

HAZARD_N = f"""terms AS (SELECT post_id, unnest({found('post_text', K.HAZARD_LEXICON)}) AS m
  FROM docs WHERE length(post_text) >= 5),
lexicon(m, type, pos) AS (VALUES {rows([(t, k, K.INCIDENT_TYPES.index(k)) for t, k in K.HAZARD_LEXICON.items()])}),
per_type AS (SELECT post_id, type, pos, count(*) AS n, sum(count(*)) OVER (PARTITION BY post_id) AS total
  FROM terms JOIN lexicon USING (m) GROUP BY post_id, type, pos),
best AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, pos) AS rn FROM per_type)"""

INTENT = f"""mentions AS (SELECT post_id, {found('post_text', [n for n, _, _ in K.gazetteer_rows()])} AS names
  FROM docs),
listed AS (SELECT post_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM mentions),
ranked AS (SELECT post_id, state, district, row_number() OVER (PARTITION BY post_id
    ORDER BY CASE WHEN district = 'Unknown District' THEN 1 ELSE 0 END, pos) AS rn
  FROM listed JOIN gaz USING (name)),
intent AS (SELECT docs.*, state AS t_state, district AS t_district FROM docs
  LEFT JOIN ranked ON ranked.post_id = docs.post_id AND rn = 1)"""

CLEAN_TEXT = squeeze(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(post_text, "
    f"'http[^{SPACE}]+', '', 'g'), '@[{WORD}]+', '', 'g'), '{KEYCAP}', '', 'g'), '{EMOJI}', '', 'g'), "
    f"'[^A-Za-z0-9{SPACE}]', '', 'g')"
)
CLEAN_CAPTION = squeeze(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(post_text, "
    f"'{KEYCAP}', '', 'g'), '{EMOJI}', '', 'g'), 'http[^{SPACE}]+|www[^{SPACE}]+', '', 'g'), "
    f"'[@#][{WORD}]+', '', 'g'), '[^a-zA-Z0-9{SPACE}.,!?]', '', 'g')"
)


def translated(c: str) -> str:
    """Whole words, longest terms first; doubled separators stand in for look-around."""
    out = f"regexp_replace(lower({c}), '([^{WORD}])', '\\1\\1', 'g')"
    for malay in sorted(K.MALAY_TERMS, key=lambda t: (-len(t), t)):
        term = malay.replace(" ", "  ")
        kind = K.MALAY_TERMS[malay].replace(" ", "  ")
        out = f"regexp_replace({out}, '(^|[^{WORD}]){term}($|[^{WORD}])', '\\1{kind}\\2', 'g')"
    return f"regexp_replace({out}, '([^{WORD}])[^{WORD}]', '\\1', 'g')"


def mentions(c: str, names) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {lit(n)})" for n in names) + ")"


def fuzzy(cols: list[str], terms: list[tuple[str, int]]) -> str:
    tests = [
        f"len(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: w <> '' AND levenshtein(w, {lit(t)}) <= {k})) > 0"
        for c in cols
        for t, k in terms
    ]
    return "(" + " OR ".join(f"coalesce({t}, false)" for t in tests) + ")"


def capitalised(c: str) -> str:
    return (
        f"array_to_string(list_transform(split({c}, ' '), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # --- events
    q["consolidate_events"] = f"WITH {POSTS}, {sessions('posts')} {CONSOLIDATED}"
    q["consolidate_incremental"] = q["consolidate_events"]
    q["consolidate_hot_districts"] = f"WITH {HOT}, {sessions('hot')} {CONSOLIDATED}"
    q["event_posts"] = f"WITH {POSTS}, {sessions('posts')} SELECT event_id, post_id FROM members"
    q["event_post_pages"] = f"""WITH {HOT}, {sessions('hot')},
sized AS (SELECT event_id, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM members GROUP BY 1)
SELECT event_id, CAST(('0x' || substr(md5(post_id), 1, 8)) AS BIGINT) % pages AS page, pages,
  string_agg(post_id, ',' ORDER BY post_id) AS ids
FROM members JOIN sized USING (event_id) GROUP BY 1, 2, 3"""
    q["event_ids"] = f"""WITH {POSTS} SELECT post_id, upper(disaster_type) || '-'
  || upper(replace(district, ' ', '')) || '-' || strftime(start_time, '%Y%m%d-%H%M%S') || '-'
  || substr(md5(post_id), 1, 4) AS event_id FROM posts"""

    # --- metrics
    q["type_counts"] = f"""WITH {EVENTS} SELECT classification_type AS type, count(*) AS frequency
FROM ev WHERE classification_type IS DISTINCT FROM 'none' GROUP BY 1"""
    q["district_ranking"] = f"WITH {EVENTS} {ranking('ev', K.RANKING_UNKNOWN)}"
    q["district_ranking_consolidated"] = f"""WITH {POSTS}, {sessions('posts')},
c AS ({CONSOLIDATED}) {ranking('c', K.RANKING_UNKNOWN)}"""
    q["monthly_events"] = f"""WITH {EVENTS} SELECT CAST(year(start_time) AS INTEGER) AS year,
  CAST(month(start_time) AS INTEGER) AS month, count(*) AS total_events FROM ev GROUP BY 1, 2"""
    q["sentiment_counts_all"] = (
        f"WITH {POSTS} SELECT label, count(*) AS frequency FROM posts GROUP BY 1"
    )
    q["sentiment_counts_filtered"] = f"""WITH {POSTS} SELECT label, count(*) AS frequency FROM posts
WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-21'
  AND disaster_type = 'flood' AND label IS NOT NULL GROUP BY 1"""
    q["dashboard_facets"] = (
        f"WITH {EVENTS}, {ALL_TIME}, {POSTS} "
        + facets("alltime", "true", K.RANKING_UNKNOWN, "posts")
    )
    q["dashboard_facets_filtered"] = f"""WITH {EVENTS}, {POSTS},
kept AS (SELECT * FROM ev WHERE most_recent_report >= TIMESTAMP '1997-01-01'
  AND most_recent_report < TIMESTAMP '2024-01-21'),
kept_posts AS (SELECT * FROM posts WHERE start_time >= TIMESTAMP '1997-01-01'
  AND start_time < TIMESTAMP '2024-01-21' AND label IS NOT NULL) """ + facets(
        "kept",
        "classification_type IS DISTINCT FROM 'none'",
        K.FILTERED_RANKING_UNKNOWN,
        "kept_posts",
    )
    one = lambda facet, fields, order: (
        f"(SELECT coalesce(string_agg({fields}, ',' ORDER BY {order}), '') FROM f WHERE facet = '{facet}') AS {facet}"
    )
    named = "coalesce(key, '-') || ':' || frequency", "key NULLS FIRST, frequency"
    q["dashboard_document"] = f"""WITH {EVENTS}, {ALL_TIME}, {POSTS},
f AS ({facets('alltime', 'true', K.RANKING_UNKNOWN, 'posts')})
SELECT '2024-02-01 00:00:00' AS timestamp, {one('type_counts', *named)}, {one('district_ranking', *named)},
  {one('monthly_events', "coalesce(year || ':' || month, '-:-') || ':' || frequency", 'year NULLS FIRST, month')},
  {one('sentiment_counts', *named)}"""
    trend = """SELECT lower(trim(token)) AS keyword, count(*) AS frequency FROM (
  SELECT unnest(split({field}, ',')) AS token FROM texts
  WHERE start_time >= TIMESTAMP '2024-01-03' AND start_time < TIMESTAMP '2024-01-26'
    AND {field} NOT IN ('null', '', 'none') AND {extra})
WHERE trim(token) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"""
    q["trending_terms"] = f"WITH {POSTS} " + trend.format(field="keywords", extra="true", n=10)
    q["trending_hashtags"] = f"WITH {POSTS} " + trend.format(
        field="hashtags", extra="disaster_type = 'flood'", n=5
    )
    q["canonical_topic_counts"] = f"WITH {TOPICS} SELECT term, frequency FROM topic_n"
    q["hashtag_counts"] = f"""WITH {POSTS} SELECT replace(lower(trim(tag)), '#', '') AS term,
  count(*) AS frequency FROM (SELECT unnest(split(hashtags, ',')) AS tag FROM texts
  WHERE hashtags <> 'null') GROUP BY 1"""
    q["tracking_terms"] = f"WITH {TOPICS} SELECT term, type, frequency FROM tracking"
    q["top_keywords"] = f"""WITH {TOPICS} SELECT term AS keyword, frequency FROM tracking
WHERE type = 'keyword' ORDER BY frequency DESC, term LIMIT 10"""
    q["monthly_series_filled"] = f"""WITH {EVENTS} SELECT CAST(m AS INTEGER) AS month,
  count(event_id) AS value FROM range(1, 13) r(m)
LEFT JOIN ev ON year(start_time) = 2001 AND month(start_time) = m GROUP BY 1"""
    q["sentiment_series_filled"] = f"""WITH {POSTS} SELECT CAST(p AS INTEGER) AS position,
  lower(s) AS name, count(post_id) AS value
FROM (VALUES (0, 'Urgent'), (1, 'Warning'), (2, 'Informational')) v(p, s)
LEFT JOIN posts ON label = s AND disaster_type = 'haze'
  AND start_time < TIMESTAMP '2024-01-03' GROUP BY 1, 2"""
    q["type_cards_filled"] = f"""WITH {EVENTS} SELECT t AS type, count(event_id) AS value
FROM (SELECT unnest({array(K.INCIDENT_TYPES)}) AS t) LEFT JOIN ev ON classification_type = t
  AND most_recent_report >= TIMESTAMP '2000-01-01' AND most_recent_report < TIMESTAMP '2000-01-04'
GROUP BY 1"""
    q["empty_selection"] = f"""WITH {EVENTS} SELECT count(*) = 0 AS is_empty FROM ev
WHERE most_recent_report >= TIMESTAMP '2030-01-01' AND most_recent_report < TIMESTAMP '2031-01-01'"""
    q["month_summary"] = f"""WITH {EVENTS} SELECT classification_type, location_state,
  count(*) AS event_count FROM ev WHERE month(start_time) = 10 GROUP BY 1, 2"""
    q["share_of_max"] = f"""WITH {EVENTS}, r AS ({ranking('ev', K.RANKING_UNKNOWN)})
SELECT district, event_count, round(event_count / (SELECT max(event_count) FROM r) * 100.0, 6) AS share
FROM r"""
    q["display_labels"] = f"""WITH {EVENTS}, r AS ({ranking('ev', K.RANKING_UNKNOWN)})
SELECT district, {capitalised('district')} AS label FROM r
UNION ALL SELECT district, '#' || lower(replace(district, ' ', '')) FROM r"""

    # --- lists
    q["events_in_date_range"] = f"""WITH {EVENTS} SELECT event_id, most_recent_report FROM ev
WHERE CAST(most_recent_report AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'"""
    known = f"""location_state IS NOT NULL AND location_state NOT IN {UNKNOWN}
  AND location_district IS NOT NULL AND location_district NOT IN {UNKNOWN}"""
    q["events_filtered"] = f"""WITH {EVENTS} SELECT {FLAT} FROM ev WHERE {known} AND {VALID}
  AND classification_type = 'forest fire'
  AND CAST(most_recent_report AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""
    q["events_filtered_by_state"] = f"""WITH {EVENTS} SELECT {FLAT} FROM ev WHERE {VALID}
  AND location_state = 'johor' AND location_district IN {within(K.STATE_DISTRICTS['johor'])}"""
    q["events_valid_geometry"] = f"WITH {EVENTS} SELECT event_id FROM ev WHERE {VALID}"
    q["events_filter_start_time"] = f"""WITH {EVENTS} SELECT event_id, start_time FROM ev
WHERE classification_type = 'haze' AND lower(location_state) = 'selangor'
  AND CAST(start_time AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'"""
    q["map_markers"] = f"""WITH {EVENTS} SELECT event_id FROM ev
WHERE coalesce(lower(classification_type), '') NOT IN ('none', '')
  AND coalesce(lower(location_district), '') NOT IN ('unknown district', '')
  AND coalesce(lower(location_state), '') NOT IN ('unknown state', '')"""
    q["events_by_ids"] = f"""WITH {EVENTS} SELECT event_id,
  strftime(start_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_time) % 1000000 = 0 THEN '' ELSE strftime(start_time, '.%f') END AS start_time, total_posts_count FROM ev
WHERE event_id IN (SELECT 'EV-' || CAST(l_orderkey AS VARCHAR) FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity >= 49)"""
    q["event_index_projection"] = f"""WITH {EVENTS} SELECT event_id, classification_type,
  location_district, location_state, strftime(start_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_time) % 1000000 = 0 THEN '' ELSE strftime(start_time, '.%f') END AS start_time,
  lon, lat, total_posts_count FROM ev"""
    q["post_index_projection"] = f"""WITH {POSTS} SELECT post_id, disaster_type, post_text,
  state AS location_state, district AS location_district,
  strftime(start_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_time) % 1000000 = 0 THEN '' ELSE strftime(start_time, '.%f') END AS start_time, label AS sentiment FROM texts"""
    q["search_posts"] = f"""WITH {POSTS} SELECT post_id FROM texts
WHERE start_time >= TIMESTAMP '2024-01-02' AND start_time < TIMESTAMP '2024-01-29'
  AND (state ILIKE '%nation\\_1%' ESCAPE '\\' OR district ILIKE '%nation\\_1%' ESCAPE '\\'
    OR state ILIKE '%nation\\_7%' ESCAPE '\\' OR district ILIKE '%nation\\_7%' ESCAPE '\\'
    OR state ILIKE '%district 44%' OR district ILIKE '%district 44%')
  AND disaster_type = 'flood' AND label ILIKE '%warn%'
  AND (post_text ILIKE '%topic 1%' OR keywords ILIKE '%topic 1%')"""
    q["search_posts_by_pattern"] = f"""WITH {POSTS} SELECT post_id FROM texts
WHERE regexp_matches(post_text, '(?i)report [0-9]*7 level')
  OR regexp_matches(keywords, '(?i)report [0-9]*7 level')"""
    q["export_flat_posts"] = f"""WITH {POSTS} SELECT post_id AS id, post_id, 'Confirmed' AS status,
  disaster_type, strftime(start_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_time) % 1000000 = 0 THEN '' ELSE strftime(start_time, '.%f') END AS start_time, post_text, state, district,
  lon AS longitude, lat AS latitude, coalesce(label, '') AS sentiment_label,
  CASE WHEN label IS NOT NULL THEN round(value / 500, 4) END AS sentiment_confidence,
  CASE WHEN label IS NOT NULL THEN 'value' ELSE '' END AS sentiment_reasoning, keywords
FROM (SELECT * FROM texts WHERE disaster_type = 'storm' AND start_time >= TIMESTAMP '2024-01-10'
  ORDER BY start_time DESC, post_id LIMIT 500)"""
    place = ["location_state", "location_district"]
    q["retrieve_events"] = f"""WITH {EVENTS} SELECT event_id, start_time FROM ev
WHERE {fuzzy(place, [('jhor', 1)])} AND classification_type = 'flood'
  AND month(start_time) = 3 AND year(start_time) = 1998
ORDER BY start_time DESC, event_id LIMIT 50"""
    q["retrieve_latest"] = f"""WITH {EVENTS} SELECT event_id, start_time FROM ev
ORDER BY start_time DESC, event_id LIMIT 1"""
    q["retrieve_day"] = f"""WITH {EVENTS} SELECT event_id, start_time FROM ev
WHERE CAST(start_time AS DATE) = DATE '1998-10-03'"""
    q["fuzzy_place_match"] = f"""WITH {EVENTS} SELECT event_id, location_state, location_district
FROM ev WHERE {fuzzy(place, [('selangr', 2), ('kota', 1), ('tingi', 1)])}"""
    q["date_presets"] = f"""WITH {POSTS},
spans(preset, first_day, last_day) AS (VALUES
  ('this-week', DATE '2024-01-22', DATE '2024-01-24'), ('last-week', DATE '2024-01-15', DATE '2024-01-21'),
  ('this-month', DATE '2024-01-01', DATE '2024-01-24'),
  ('last-30-days', DATE '2023-12-25', DATE '2024-01-24'),
  ('this-year', DATE '2024-01-01', DATE '2024-01-24'))
SELECT preset, first_day, last_day, count(post_id) AS event_count FROM spans
LEFT JOIN posts ON CAST(start_time AS DATE) BETWEEN first_day AND last_day GROUP BY 1, 2, 3"""

    # --- text
    q["clean_text"] = f"WITH {DOCS} SELECT post_id, {CLEAN_TEXT} AS cleaned FROM docs"
    q["clean_caption"] = f"WITH {DOCS} SELECT post_id, {CLEAN_CAPTION} AS cleaned FROM docs"
    q["clean_hashtags"] = f"""SELECT p_partkey, array_to_string(list_transform(
  split('#' || p_brand || ', #' || p_name || '!,,', ','),
  lambda t: regexp_replace(lower(t), '[^{WORD}]', '', 'g')), ', ') AS hashtags FROM part"""
    stop = array(K.ENGLISH_STOPWORDS + K.MALAY_STOPWORDS)
    q["tokenize"] = f"""WITH {DOCS} SELECT post_id, array_to_string(list_filter(
  regexp_split_to_array(lower(post_text), '[^{WORD}]+'),
  lambda t: regexp_full_match(t, '\\p{{L}}+') AND NOT list_contains({stop}, t)), ' ') AS tokens
FROM docs"""
    q["normalise_terms"] = f"WITH {DOCS} SELECT post_id, {translated('post_text')} AS text FROM docs"
    q["tidy_topics"] = f"""WITH {DOCS} SELECT post_id, regexp_replace(regexp_replace(lower(post_text),
  '[^{WORD}{SPACE}]', '', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS topic FROM docs"""
    q["format_place"] = """SELECT p_partkey, CASE WHEN p_size <= 3 THEN 'Unknown District'
  ELSE lower(p_name) END AS place FROM part"""
    q["canonical_state"] = f"""WITH {EVENTS}, {STATES} SELECT event_id,
  coalesce(display, location_state) AS state,
  coalesce(lower(trim(location_state)) IN {within(K.STATE_WHITELIST)}, false) AS known
FROM ev LEFT JOIN states ON alias = lower(trim(location_state))"""
    q["parse_dates"] = """SELECT event_id, CASE WHEN event_type IN ('click', 'view')
  THEN CAST(date_trunc('second', ts) AS TIMESTAMP) ELSE TIMESTAMP '2024-06-01' END AS parsed FROM events"""
    q["epoch_to_ts"] = """SELECT event_id, CASE WHEN event_type <> 'error'
  THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END AS at FROM events"""
    q["normalise_missing"] = f"""WITH {EVENTS} SELECT event_id, {missing('classification_type')},
  {missing('location_state')}, {missing('location_district')} FROM ev"""

    # --- ingest
    q["parse_event_props"] = """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  false AS is_broken FROM events"""
    spot = pick([*K.PLACE_KEYWORDS, "nowhere", ""], "c_custkey % 30")
    q["ingest_timeline_feed"] = f"""WITH c AS (SELECT *, {spot} AS spot FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS tweet_id,
  CASE WHEN spot = '' THEN 'Ipoh' ELSE {capitalised('spot')} END AS location,
  CASE WHEN c_nationkey > 5 THEN 'banjir' END AS tweet_hashtags, 'Flood' AS cleaned_text
FROM c WHERE c_nationkey <> 3 AND spot <> 'nowhere' AND c_acctbal <= 9000
  AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND trunc(c_acctbal * 2) <= 10000"""
    city = pick([*K.PLACE_NAMES, "elsewhere"], "c_custkey % 41")
    q["ingest_item_feed"] = f"""WITH c AS (SELECT *, {city} AS city FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS ig_post_id,
  make_timestamp((1705915829 + c_custkey) * 1000000) AS created_at, city,
  regexp_replace('Banjir!!! ' || c_name, '#[0-9]+', '') AS cleaned_description,
  'banjir, ' || lower(c_mktsegment) AS cleaned_hashtags_str
FROM c WHERE c_nationkey % 3 <> 2 AND c_acctbal > 0 AND c_nationkey > 4 AND city <> 'elsewhere'"""
    q["ingest_rejects"] = """SELECT 'item' AS reason, unnest(['5', 'x']) AS text FROM customer
UNION ALL SELECT 'document', '{"data": ' || c_custkey FROM customer WHERE c_custkey % 7 = 0"""
    q["unify_posts"] = f"""SELECT CAST(doc_id AS VARCHAR) AS "postId", nullif(text, '') AS "postText",
  CASE WHEN lang = 'en' THEN 'Fri Apr 11 13:57:55 +0000 2025' ELSE '2025-04-11T13:57:55Z' END AS "createdAt",
  CASE WHEN lang = 'en' AND doc_id % 3 <> 0 THEN 'Flood,#Help' ELSE '' END AS hashtags,
  CASE WHEN lang = 'en' THEN 'Place ' ELSE 'Spot ' END || source AS location,
  CAST(NULL AS VARCHAR) AS address, CASE WHEN lang <> 'en' THEN lang END AS city,
  CASE WHEN lang <> 'en' THEN {lat('doc_id')} END AS latitude,
  CASE WHEN lang <> 'en' THEN {lon('doc_id')} END AS longitude,
  CASE WHEN lang = 'en' THEN 'u' ELSE 'a' END || CAST(doc_id AS VARCHAR) AS author_id,
  CASE WHEN lang = 'en' THEN '' ELSE 'name ' || CAST(doc_id AS VARCHAR) END AS author_name,
  1000e0 AS "processedAt", CASE WHEN lang = 'en' THEN 'Twitter' ELSE 'Instagram' END AS source
FROM documents"""
    q["filter_place_mention"] = (
        f"WITH {DOCS} SELECT post_id FROM docs WHERE {mentions('post_text', K.PLACE_KEYWORDS)}"
    )
    q["filter_any_place_column"] = f"""WITH {EVENTS} SELECT event_id FROM ev
WHERE coalesce({mentions('location_state', K.PLACE_NAMES)}, false)
  OR coalesce({mentions('location_district', K.PLACE_NAMES)}, false)"""
    q["filter_authority_accounts"] = """SELECT c_custkey FROM customer WHERE c_acctbal <= 9000
  AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND trunc(c_acctbal * 2) <= 10000"""
    q["filter_null_safe_ne"] = """SELECT c_custkey, nullif(c_nationkey % 4, 3) AS account_type
FROM customer WHERE nullif(c_nationkey % 4, 3) IS DISTINCT FROM 2"""
    q["drop_all_null"] = f"""WITH {EVENTS} SELECT event_id FROM ev WHERE classification_type IS NOT NULL
  AND coalesce(location_state, location_district, CAST(last_alert_sent AS VARCHAR)) IS NOT NULL"""
    q["filter_min_text"] = "SELECT doc_id FROM documents WHERE length(text) >= 10"
    q["filter_bounding_box"] = f"""WITH {POSTS} SELECT post_id, lat, lon FROM posts
WHERE lat BETWEEN {K.LAT_MIN} AND {K.LAT_MAX} AND lon BETWEEN {K.LON_MIN} AND {K.LON_MAX}"""
    q["authentic_posts"] = f"""WITH {DOCS}, {CHECKS} SELECT post_id, check_id, post_text
FROM docs JOIN checks USING (post_id) WHERE check_label = 'AUTHENTIC'"""
    q["dedupe_first"] = """SELECT user_id, ts, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""

    # --- keyed tables
    q["insert_if_absent"] = """SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""
    q["insert_counts"] = """WITH n AS (SELECT count(DISTINCT l_orderkey) AS inserted FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
SELECT inserted, (SELECT count(*) FROM lineitem) - inserted AS skipped FROM n"""
    q["upsert_by_key"] = """WITH s AS (SELECT o_custkey + 100 AS k, o_orderdate AS last_order,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS balance FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT coalesce(c_custkey, k) AS c_custkey, c_name,
  CASE WHEN k IS NOT NULL THEN balance ELSE c_acctbal END AS c_acctbal, c_mktsegment, last_order
FROM customer FULL JOIN s ON k = c_custkey"""
    q["subscription_upsert"] = f"""WITH {SUBS},
asked AS (SELECT email FROM subs WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_acctbal >= 0)
SELECT email, CASE WHEN email IN (SELECT email FROM asked) THEN 'Perlis' ELSE
    CASE WHEN first_location = second_location THEN first_location
      ELSE first_location || ',' || second_location END END AS locations,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 2000e0 ELSE 1000e0 END AS "createdAt",
  CASE WHEN email IN (SELECT email FROM asked) THEN 2000e0 ELSE 1000e0 END AS "updatedAt"
FROM subs WHERE c_mktsegment <> 'BUILDING' OR c_acctbal >= 0"""
    doomed = "SELECT DISTINCT o_custkey * 2 AS k FROM orders WHERE o_orderstatus = 'P'"
    q["delete_by_key"] = f"""SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN ({doomed})"""
    q["delete_report"] = f"""SELECT k AS c_custkey, k IN (SELECT c_custkey FROM customer) AS deleted
FROM ({doomed})"""
    q["bulk_keyed_update"] = f"""WITH {LOCATED} SELECT post_id AS "postId",
  CASE WHEN toxic = 0 THEN 'topic ' || CAST(quality AS VARCHAR) ELSE keywords END AS keywords,
  l.doc_id IS NOT NULL OR keywords_generated AS keywords_generated
FROM located LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = post_id"""
    waiting = "SELECT CAST(doc_id AS VARCHAR) AS post_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    q["pending_posts"] = waiting
    q["pending_batch"] = f"{waiting} ORDER BY 1 LIMIT 100"
    q["pending_geo"] = f"""WITH {LOCATED} SELECT post_id AS "postId" FROM located
WHERE geo_processed IS DISTINCT FROM true OR state = 'Unknown State' OR confidence_score < 0.3"""
    q["move_raw_geo"] = f"""WITH {LOCATED} SELECT post_id AS "postId", state, lon AS longitude,
  source AS location, NULL::VARCHAR AS address, lang AS city FROM located WHERE has_geo"""
    q["stage_counts"] = f"""WITH {LOCATED} SELECT count(*) AS total,
  count(*) FILTER (geo_processed IS DISTINCT FROM true) AS pending_geo,
  count(*) FILTER (state = 'Unknown State') AS unknown_state,
  count(*) FILTER (NOT keywords_generated) AS pending_keywords FROM located"""
    q["assemble_posts"] = f"""WITH {LOCATED} SELECT post_id, classification_type AS disaster_type,
  created AS start_time, state, source AS district, lon, text AS post_text,
  CASE WHEN keywords = 'old topic' THEN keywords ELSE '' END AS keywords,
  lang || ',' || source AS hashtags, label, confidence
FROM located JOIN incident USING (post_id) JOIN severity USING (post_id) WHERE has_geo"""
    q["assembly_gaps"] = f"""WITH {LOCATED} SELECT * FROM (
  SELECT i.post_id, l.post_id IS NOT NULL AS has_post, coalesce(l.has_geo, false) AS has_geo,
    s.post_id IS NOT NULL AS has_severity
  FROM incident i LEFT JOIN located l ON l.post_id = i.post_id
  LEFT JOIN severity s ON s.post_id = i.post_id)
WHERE NOT (has_post AND has_geo AND has_severity)"""

    # --- places
    q["gazetteer_lookup"] = f"""WITH {EVENTS}, {GAZETTEER} SELECT event_id, state, district
FROM ev LEFT JOIN gaz ON name = lower(trim(location_district))"""
    q["place_intent"] = f"""WITH {DOCS}, {GAZETTEER}, {INTENT}
SELECT post_id, t_state AS state, t_district AS district FROM intent"""
    q["query_matrix"] = f"""SELECT t || ' ' || n_name AS query FROM nation,
  (SELECT unnest({array(K.SEARCH_TERMS)}) AS t)"""
    q["point_in_polygon"] = f"""WITH {POSTS}, {POLYGONS}, {hits('posts')}
SELECT post_id, hits.polygon_id, boxes.state, boxes.district FROM posts
LEFT JOIN hits USING (post_id) LEFT JOIN boxes ON boxes.polygon_id = hits.polygon_id"""
    q["resolve_geo"] = f"""WITH {DOCS}, {STATES}, {GAZETTEER}, {INTENT}, {POLYGONS},
points AS (SELECT post_id, latitude AS lat, longitude AS lon FROM docs), {hits('points')},
middles AS (SELECT polygon_id, lower(coalesce(display, state)) AS state, district,
  (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM corners LEFT JOIN states ON alias = lower(trim(state))),
rescue AS (
  SELECT state, district AS named, arg_min(district, polygon_id) AS district,
    arg_min(lat, polygon_id) AS lat, arg_min(lon, polygon_id) AS lon FROM middles GROUP BY 1, 2
  UNION ALL SELECT state, 'Unknown District', arg_min(district, polygon_id),
    arg_min(lat, polygon_id), arg_min(lon, polygon_id) FROM middles GROUP BY 1),
facts AS (SELECT i.post_id, i.latitude, i.longitude, i.t_state, b.state AS g_state,
    b.district AS g_district, coalesce(r.district, w.district) AS r_district,
    coalesce(r.lat, w.lat) AS r_lat, coalesce(r.lon, w.lon) AS r_lon,
    CASE WHEN lower(coalesce(gs.display, b.state)) = lower(coalesce(ts.display, t_state)) THEN 1
      WHEN coalesce(r.lat, w.lat) IS NOT NULL THEN 2
      WHEN b.state IS NOT NULL THEN 3 ELSE 4 END AS how
  FROM intent i LEFT JOIN hits ON hits.post_id = i.post_id
  LEFT JOIN boxes b ON b.polygon_id = hits.polygon_id
  LEFT JOIN states gs ON gs.alias = lower(trim(b.state)) LEFT JOIN states ts ON ts.alias = lower(trim(t_state))
  LEFT JOIN rescue r ON r.state = lower(coalesce(ts.display, t_state)) AND r.named = t_district
  LEFT JOIN rescue w ON w.state = lower(coalesce(ts.display, t_state)) AND w.named = 'Unknown District')
SELECT post_id, CASE how WHEN 2 THEN t_state WHEN 4 THEN 'Unknown State' ELSE g_state END AS state,
  CASE how WHEN 2 THEN r_district WHEN 4 THEN 'Unknown District' ELSE g_district END AS district,
  round(CASE how WHEN 2 THEN r_lat ELSE latitude END, 6) AS lat,
  round(CASE how WHEN 2 THEN r_lon ELSE longitude END, 6) AS lon,
  how < 4 OR coalesce(latitude BETWEEN {K.LAT_MIN} AND {K.LAT_MAX}
    AND longitude BETWEEN {K.LON_MIN} AND {K.LON_MAX}, false) AS is_malaysia,
  CASE how WHEN 1 THEN 1e0 WHEN 2 THEN 0.8e0 WHEN 3 THEN 0.6e0 ELSE 0e0 END AS confidence_score,
  CASE how WHEN 1 THEN 'gps_verified_by_ai' WHEN 2 THEN 'ai_opencage_rescue' WHEN 3 THEN 'gps_only'
    ELSE 'none' END AS inference
FROM facts"""
    q["map_extent"] = f"""WITH {EVENTS} SELECT 'box' AS mode, count(*) AS events,
  (min(lat) + max(lat)) / 2 AS centre_lat, (min(lon) + max(lon)) / 2 AS centre_lon,
  min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east,
  CAST(NULL AS INTEGER) AS zoom FROM ev WHERE {VALID}"""
    q["marker_grid"] = f"""WITH {EVENTS} SELECT CAST(floor(lon) AS BIGINT) AS cell_x,
  CAST(floor(lat) AS BIGINT) AS cell_y, count(*) AS events,
  CASE WHEN count(*) >= 50 THEN 'large' WHEN count(*) >= 10 THEN 'medium' ELSE 'small' END AS size_class
FROM ev WHERE {VALID} GROUP BY 1, 2"""

    # --- labels
    q["label_incident"] = f"""WITH {DOCS}, {HAZARD_N} SELECT docs.post_id,
  coalesce(type, 'none') AS classification_type,
  coalesce(round(n / total, 4), 1e0) AS confidence_score
FROM docs LEFT JOIN best ON best.post_id = docs.post_id AND rn = 1"""
    q["label_severity"] = f"""WITH {DOCS}, n AS (SELECT post_id,
    len({found('post_text', K.URGENT_TERMS)}) AS u, len({found('post_text', K.WARNING_TERMS)}) AS w FROM docs)
SELECT post_id, CASE WHEN u > 0 THEN 'Urgent' WHEN w > 0 THEN 'Warning' ELSE 'Informational' END
    AS sentiment_label,
  CASE WHEN u > 0 THEN round(CAST(u AS DOUBLE) / (u + w), 4) WHEN w > 0 THEN 1e0 ELSE 0.5e0 END
    AS confidence_level FROM n"""
    q["label_authenticity"] = f"""WITH {DOCS}, f AS (SELECT post_id,
    CAST(len({found('post_text', [n for n, _, _ in K.gazetteer_rows()])}) > 0 AS INTEGER) AS place,
    CAST(regexp_matches(lower(post_text), '{K.MEASURE_PATTERN}') AS INTEGER) AS measure,
    CAST(len({found('post_text', K.FIRST_HAND_TERMS)}) > 0 AS INTEGER) AS witness,
    CAST(len({found('post_text', K.OFFICIAL_TERMS)}) > 0 AS INTEGER) AS official,
    CAST(len({found('post_text', K.DRAMATIC_TERMS)}) > 0 AS INTEGER) AS dramatic FROM docs)
SELECT post_id, CASE WHEN dramatic = 1 AND measure = 0 AND official = 0 THEN 'MISINFORMATION'
    WHEN official = 1 OR (place = 1 AND (measure = 1 OR witness = 1)) THEN 'AUTHENTIC'
    ELSE 'UNCERTAIN' END AS check_label,
  round(0.5e0 + (place + measure + witness + official) * 0.125e0, 3) AS confidence FROM f"""
    q["topic_phrase"] = f"""WITH {DOCS}, {HAZARD_N}, {GAZETTEER}, {INTENT} SELECT i.post_id,
  CASE WHEN length(i.post_text) >= 10 AND type IS NOT NULL THEN type || coalesce(' in ' ||
    CASE WHEN t_district = 'Unknown District' THEN t_state ELSE t_district END, '') END AS topic
FROM intent i LEFT JOIN best ON best.post_id = i.post_id AND rn = 1"""
    q["canonical_topics"] = f"""WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a,
    split_part(p_name, ' ', 2) AS b FROM part),
v AS (SELECT DISTINCT topic, key FROM (
  SELECT a || ' ' || b AS topic, least(a, b) || ' ' || greatest(a, b) AS key FROM names
  UNION ALL SELECT b || ' in ' || a, least(a, b) || ' ' || greatest(a, b) FROM names
  UNION ALL SELECT a || ' ' || b || ' Road', least(a, b) || ' ' || greatest(a, b) FROM names)),
w AS (SELECT key, arg_max(topic, (length(topic), topic)) AS best FROM v GROUP BY 1)
SELECT topic, {capitalised('best')} AS canonical FROM v JOIN w USING (key)"""
    q["label_hook"] = f"""WITH {DOCS} SELECT post_id,
  CASE WHEN contains(post_text, '!') THEN 'Urgent' ELSE 'Informational' END AS label,
  CASE WHEN contains(post_text, '!') THEN 1e0 ELSE 0.5e0 END AS score,
  CAST(NULL AS VARCHAR) AS error FROM docs"""

    kept = "CAST(post_id AS BIGINT) % 97 <> 7 AND CAST(post_id AS BIGINT) % 10 <> 3"
    q["label_hook_rejects"] = f"""WITH {DOCS} SELECT post_id,
  CASE WHEN {kept} THEN CASE WHEN contains(post_text, '!') THEN 'Urgent' ELSE 'Informational' END END AS label,
  CASE WHEN {kept} THEN CASE WHEN contains(post_text, '!') THEN 1e0 ELSE 0.5e0 END END AS score,
  CASE WHEN CAST(post_id AS BIGINT) % 97 = 7 THEN 'ValueError: refused'
    WHEN CAST(post_id AS BIGINT) % 10 = 3 THEN 'not returned' END AS error FROM docs"""

    shouts = "contains(post_text, '!')"
    refused, silent = "CAST(post_id AS BIGINT) % 97 = 7", "CAST(post_id AS BIGINT) % 13 = 5"
    answered = f"NOT ({refused}) AND NOT ({silent})"
    q["label_gather"] = f"""WITH {DOCS} SELECT post_id,
  CASE WHEN {answered} THEN CASE WHEN {shouts} THEN 'Urgent' ELSE 'Informational' END END AS label,
  CASE WHEN {answered} THEN CASE WHEN {shouts} THEN 1e0 ELSE 0.5e0 END END AS score,
  CASE WHEN {answered} THEN CASE WHEN length(post_text) > 40 THEN 'long' ELSE 'short' END END AS tone,
  nullif(concat_ws('; ', CASE WHEN {refused} THEN 'shout: ValueError: refused' END,
    CASE WHEN {silent} THEN 'tone: not returned' END), '') AS error
FROM docs WHERE post_text IS NOT NULL"""

    # --- alerts
    q["alerts_due"] = f"WITH {EVENTS}, {DUE} SELECT event_id, location_state, start_time FROM due"
    reach = f"""WITH {EVENTS}, {DUE}, {SUBS}, {STATES}, {SUBSCRIBED},
reach AS (SELECT due.*, email FROM due LEFT JOIN states ON alias = lower(trim(location_state))
  JOIN subscribed ON subscribed.state = lower(coalesce(display, location_state)))"""
    q["alert_recipients"] = f"{reach} SELECT event_id, email FROM reach"
    q["alert_recipient_counts"] = f"""WITH {EVENTS}, {SUBS}, {STATES}, {SUBSCRIBED}
SELECT event_id, count(email) AS emails FROM ev LEFT JOIN states ON alias = lower(trim(location_state))
LEFT JOIN subscribed ON subscribed.state = lower(coalesce(display, location_state)) GROUP BY 1"""
    q["alert_outbox"] = f"""{reach} SELECT event_id, email,
  'ALERT: ' || upper(coalesce(classification_type, 'Disaster')) || ' Detected in '
    || coalesce(location_district, 'Unknown Location') AS subject,
  {capitalised('location_state')} AS state,
  strftime(start_time, '%Y-%m-%d %H:%M:%S UTC') AS first_reported,
  '{UNSUBSCRIBE}?email=' || email AS unsubscribe_link FROM reach"""
    q["alert_marks"] = f"""{reach} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM reach)
  THEN TIMESTAMP '{ALERT_NOW}' ELSE last_alert_sent END AS last_alert_sent FROM ev"""
    q["alert_cooldown"] = """WITH RECURSIVE
t AS (SELECT DISTINCT event_type AS event_id, epoch_us(ts) AS m FROM events),
nx AS (SELECT event_id, m, min(m) OVER (PARTITION BY event_id ORDER BY m
  RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
a AS (SELECT event_id, min(m) AS m FROM t GROUP BY 1
  UNION ALL SELECT nx.event_id, nx.nxt FROM a JOIN nx ON nx.event_id = a.event_id AND nx.m = a.m
    WHERE nxt IS NOT NULL)
SELECT event_id, make_timestamp(m) AS alert_at FROM a"""
    places = [*X.SUBSCRIBER_STATES, "Kota", "Pi", "shah alam"]
    q["substring_location_join"] = f"""WITH {EVENTS},
spots AS (SELECT DISTINCT lower(concat_ws(', ', location_district, location_state)) AS location FROM ev),
wanted AS (SELECT c_name AS email, lower({pick(places, 'c_custkey % 17')}) AS place FROM customer)
SELECT DISTINCT location, email FROM spots JOIN wanted ON contains(location, place)"""
    q["substring_location_counts"] = f"""WITH {EVENTS},
spots AS (SELECT DISTINCT lower(concat_ws(', ', location_district, location_state)) AS location FROM ev),
wanted AS (SELECT c_name AS email, lower({pick(places, 'c_custkey % 17')}) AS place FROM customer
  UNION ALL SELECT c_name, lower({pick(places, 'c_custkey % 5')}) FROM customer WHERE c_custkey % 3 = 0)
SELECT location, count(DISTINCT email) AS emails FROM spots JOIN wanted ON contains(location, place)
GROUP BY 1"""
    return q
