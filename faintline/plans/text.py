"""Queries for text functions, rules and scores of single rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from faintline.functions import rules as R
from faintline.functions import scalar as S
from faintline.operators.pairs import edit_distances
from faintline.plans.registry import query
from faintline.plans.views import AS_OF, TITLES_SQL, sql_list, titles
from faintline.sources.storage import table

W = f"WITH {TITLES_SQL} "
AGE = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400e6)"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _rlike(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '" + pattern.replace("'", "''") + "', 'i')"


def _case(rules, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _per_title(name: str, column, sql: str, out: str) -> None:
    query(name, f"{W} SELECT id, {sql} AS {out} FROM titles")(lambda s, d: titles(s, d).select("id", column().alias(out)))


T = lambda: F.col("title")
_per_title("slugify", lambda: S.slugify(T()), "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')", "slug")
_strip = "trim(title)"
for _p in R.TITLE_PREFIXES:
    _strip = f"regexp_replace({_strip}, '^{_p}\\s*', '', 'i')"
query(
    "title_normalize",
    f"""{W}, a AS (SELECT id, {_strip} AS t FROM titles), b AS (SELECT id, CASE WHEN strpos(regexp_replace(t, '[?|–—]', '?', 'g'), '?') > 11 THEN substr(t, 1, strpos(regexp_replace(t, '[?|–—]', '?', 'g'), '?') - 1) ELSE t END AS t FROM a),
    c AS (SELECT id, regexp_replace(trim(regexp_replace(t, '[,.:\\s]+$', '')), '\\s+', ' ', 'g') AS t FROM b)
    SELECT id, CASE WHEN length(t) >= 12 AND len(list_filter(string_split_regex(regexp_replace(lower(t), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(R.WEAK_TITLE_TOKENS)}, w))) >= 2 THEN t END AS normal FROM c""",
)(lambda s, d: titles(s, d).select("id", S.title_normalize(T()).alias("normal")))
_TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', ' ', 'g'), '-+', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3)"
_per_title("tokenize_concepts", lambda: F.array_join(S.concept_tokens(T()), "|"), f"array_to_string({_TOKENS}, '|')", "tokens")
_STOP, _TECH = sql_list(R.CONCEPT_STOPWORDS), sql_list(R.TECHNICAL_TERMS)
query(
    "ngram_concepts",
    f"""{W}, t AS (SELECT id, {_TOKENS} AS w FROM titles), p AS (SELECT id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
    f AS (SELECT *, list_contains({_STOP}, a) AS sa, coalesce(list_contains({_STOP}, b), true) AS sb, coalesce(list_contains({_STOP}, c), true) AS sc FROM p)
    SELECT id, a || ' ' || b || ' ' || c AS concept FROM f WHERE b IS NOT NULL AND c IS NOT NULL AND NOT sa AND NOT sb AND NOT sc UNION SELECT id, a || ' ' || b FROM f WHERE b IS NOT NULL AND NOT sa AND NOT sb
    UNION SELECT id, a FROM f WHERE NOT sa AND (list_contains({_TECH}, a) OR length(a) >= 4)""",
)(lambda s, d: titles(s, d).select("id", F.explode(S.ngram_concepts(T())).alias("concept")))
_BIG = f"list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({sql_list(R.OPPORTUNITY_STOPWORDS)}, w))"
query("bigrams", f"{W}, t AS (SELECT id, {_BIG} AS w FROM titles) SELECT id, i AS place, w[i + 1] || ' ' || w[i + 2] AS bigram FROM (SELECT id, w, unnest(range(0, len(w) - 1)) AS i FROM t)")(
    lambda s, d: titles(s, d).select("id", F.posexplode(S.bigrams(T())).alias("place", "bigram")).withColumn("place", F.col("place").cast("bigint"))
)
_per_title("dedupe_tokens", lambda: F.array_join(F.array_sort(S.dedupe_tokens(T())), "|"), f"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2 AND NOT list_contains({sql_list(R.OPPORTUNITY_STOPWORDS)}, t)))), '|')", "tokens")
for _feed, _short in (("reddit", "reddit"), ("hackernews", "hn"), ("producthunt", "ph")):
    _per_title(f"pain_{_short}", lambda f=_feed: S.feed_pain(T(), f), _case((_rlike("title", p), _q(k)) for k, p in R.FEED_PAINS[_feed].items()), "pain")
    _all = " || ".join(f"regexp_extract_all(lower(title), {_q(chr(92) + 'b(' + p.lower() + ')' + chr(92) + 'b')})" for p in R.FEED_KEYWORDS[_feed])
    query(f"kw_{_short}", f"{W}, t AS (SELECT id, {_all} AS k FROM titles), u AS (SELECT id, k, unnest(range(1, len(k) + 1)) AS i FROM t), f AS (SELECT id, k[i] AS keyword, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM f) SELECT id, keyword, place FROM r WHERE place <= {R.MOST_KEYWORDS}")(
        lambda s, d, f=_feed: titles(s, d).select("id", F.posexplode(S.feed_keywords(F.lower(T()), f)).alias("place", "keyword")).withColumn("place", (F.col("place") + 1).cast("bigint"))
    )
_CLASS = _case((" OR ".join(_rlike("title", p) for p in ps), _q(k)) for k, ps in R.PAIN_CLASSES.items())
_per_title("pain_class", lambda: S.pain_class(T()), _CLASS, "pain_class")
_per_title("gap_type", lambda: S.gap_type(T()), _case((_any("lower(title)", w), _q(k)) for k, w in R.GAP_TYPES.items()), "gap_type")
_count = lambda words: " + ".join(f"CAST(contains(lower(title), {_q(w)}) AS INT)" for w in words)
_scores = "[" + ", ".join(_count(w) for w in R.TRENDS.values()) + "]"
_per_title("canonical_trend", lambda: S.canonical_trend(T()), f"CASE WHEN list_max({_scores}) > 0 THEN {sql_list(R.TRENDS)}[list_position({_scores}, list_max({_scores}))] END", "trend")
_per_title("capitalize", lambda: S.capitalize(F.lower(F.get(F.split(T(), " "), 0))), "CASE lower(string_split(title, ' ')[1]) WHEN '' THEN '' WHEN 'ai' THEN 'AI' WHEN 'ai agents' THEN 'AI Agents' ELSE upper(substr(lower(string_split(title, ' ')[1]), 1, 1)) || substr(lower(string_split(title, ' ')[1]), 2) END", "word")
_proper = lambda word, title="title": f"len(list_filter(string_split_regex({title}, '\\s+'), lambda v: length(v) >= 3 AND lower(regexp_replace(v, '[^a-zA-Z0-9]', '', 'g')) = {word} AND substr(regexp_replace(v, '[^a-zA-Z0-9]', '', 'g'), 1, 1) = upper(substr(regexp_replace(v, '[^a-zA-Z0-9]', '', 'g'), 1, 1)))) > 0"
query("is_proper_noun", f"{W}, w AS (SELECT id, title, unnest(list_distinct(string_split(lower(title), ' '))) AS word FROM titles) SELECT id, word, {_proper('w.word')} AS proper FROM w")(
    lambda s, d: titles(s, d).select("id", "title", S.proper_nouns(T()).alias("nouns")).select("id", "nouns", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word")).select("id", "word", F.exists("nouns", lambda n: n == F.col("word")).alias("proper"))
)
query(
    "primary_keyword",
    f"""{W}, k AS (SELECT id, title, lower(trim(keywords[i])) AS kw, i FROM (SELECT id, title, keywords, unnest(range(1, 4)) AS i FROM titles)),
    s AS (SELECT id, kw, i, CASE WHEN list_contains({sql_list(R.CATEGORIES)}, kw) THEN 20 ELSE 0 END + CASE WHEN {_proper('k.kw')} THEN -50 ELSE 0 END + length(kw) AS sc FROM k WHERE length(kw) >= 3 AND NOT list_contains({sql_list(R.OPPORTUNITY_STOPWORDS)}, kw)),
    b AS (SELECT id, kw FROM (SELECT id, kw, row_number() OVER (PARTITION BY id ORDER BY sc DESC, i) AS r FROM s WHERE sc > 0) WHERE r = 1)
    SELECT titles.id AS id, coalesce({_case((f"contains(lower(title), '{c}')", f"'{c}'") for c in R.CATEGORIES)}, b.kw) AS keyword FROM titles LEFT JOIN b ON b.id = titles.id WHERE coalesce({_case((f"contains(lower(title), '{c}')", f"'{c}'") for c in R.CATEGORIES)}, b.kw) IS NOT NULL""",
)(lambda s, d: titles(s, d).select("id", S.primary_keyword(T(), F.col("keywords")).alias("keyword")).filter("keyword IS NOT NULL"))
_place = lambda text, whole, part, terms: f"CASE WHEN contains({text}, 'api monitoring') THEN {whole} ELSE 0 END + " + " + ".join(f"CASE WHEN contains({text}, '{t}') THEN {part} ELSE 0 END" for t in terms)
_bonus = _place("lower(title)", 60, 15, ("api", "monitoring")) + " + " + _place("array_to_string(keywords, ' ')", 40, 12, ("api", "monitoring"))
query("topic_rank", f"{W} SELECT id, CASE WHEN {_bonus} = 0 THEN 0 ELSE score + {_bonus} END AS rank FROM titles")(lambda s, d: titles(s, d).select("id", S.topic_rank(T(), F.lit(None).cast("string"), F.col("keywords"), F.col("score"), "API monitoring").alias("rank")))
query("topic_rank_filter", f"{W}, r AS (SELECT id, CASE WHEN {_bonus} = 0 THEN 0 ELSE score + {_bonus} END AS rank FROM titles) SELECT * FROM r WHERE rank > 0")(lambda s, d: titles(s, d).select("id", S.topic_rank(T(), F.lit(None).cast("string"), F.col("keywords"), F.col("score"), "API monitoring").alias("rank")).filter("rank > 0"))
query("top_ranked_topic", f"{W}, r AS (SELECT id, CASE WHEN {_bonus} = 0 THEN 0 ELSE score + {_bonus} END AS rank FROM titles) SELECT * FROM r WHERE rank > 0 ORDER BY rank DESC, id LIMIT 6")(
    lambda s, d: titles(s, d).select("id", S.topic_rank(T(), F.lit(None).cast("string"), F.col("keywords"), F.col("score"), "API monitoring").alias("rank")).filter("rank > 0").orderBy(F.desc("rank"), "id").limit(6)
)
_per_title("pain_agentic", lambda: S.agent_pain(T(), F.col("source")), _case(((_any("lower(title)", w), _q(t)) for w, t in R.AGENT_PAINS), "'managing ' || source || ' workflows efficiently'"), "pain")
_PAIN = _case(((_any("lower(title)", w), _q(t)) for w, t in R.AGENT_PAINS), "'managing ' || source || ' workflows efficiently'")
_filled = lambda template, **values: " || ".join(values[x] if i % 2 else _q(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)))
_WORD = "keywords[2]"
_CAPITAL = f"CASE {_WORD} WHEN 'ai' THEN 'AI' ELSE upper({_WORD}[1:1]) || {_WORD}[2:] END"
_per_title("explanation_text", lambda: S.filled(R.EXPLANATION, source=F.col("source"), pain=S.agent_pain(T(), F.col("source")), keyword=S.capitalize(F.get("keywords", 1))), _filled(R.EXPLANATION, source="source", pain=_PAIN, keyword=_CAPITAL), "explanation")
_per_title("idea_text", lambda: S.filled(R.IDEA, pain=S.agent_pain(T(), F.col("source"))), _filled(R.IDEA, pain=_PAIN), "idea")
_SNAPS = f"{W}, g AS (SELECT id % 500 AS opportunity_id, list(source ORDER BY id) AS sources, count(*) AS n, max(score) AS score, string_agg('{{place}}. **' || upper(source) || '**: ' || title || ' (score: ' || CAST(score AS BIGINT) || ', comments: ' || CAST(engagement AS BIGINT) || ')', chr(10) ORDER BY id) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY id % 500 ORDER BY id) AS place FROM titles) GROUP BY 1), f AS (SELECT opportunity_id, array_to_string(list_filter(sources, lambda x, i: list_position(sources, x) = i), ', ') AS sources, n, CAST(score AS BIGINT) AS score, signals FROM g)".replace("'{place}. **'", "place || '. **'")


def _snapshots(s, d):
    """The signals of an opportunity, in order; a few for each."""
    one = F.struct("source", "title", F.col("score").cast("bigint").alias("score"), F.col("engagement").cast("bigint").alias("comments"))
    grouped = titles(s, d).groupBy((F.col("id") % 500).alias("opportunity_id")).agg(F.sort_array(F.collect_list(F.struct("id", one.alias("one")))).alias("all"), F.max("score").cast("bigint").alias("score"))
    return grouped.select("opportunity_id", "score", F.transform("all", lambda x: x["one"]).alias("signals"))


query("prediction_text", f"{_SNAPS} SELECT opportunity_id, {_filled(R.PREDICTION, title=_q('Opportunity ') + ' || opportunity_id', sources='sources')} AS prediction FROM f")(
    lambda s, d: _snapshots(s, d).select("opportunity_id", S.filled(R.PREDICTION, title=F.concat(F.lit("Opportunity "), F.col("opportunity_id").cast("string")), sources=F.array_join(F.array_distinct(F.transform("signals", lambda x: x["source"])), ", ")).alias("prediction"))
)
query("methodology_notes", f"{_SNAPS} SELECT opportunity_id, {_filled(R.METHODOLOGY, score='score', count='n', sources='sources', signals='signals', at=_q(AS_OF))} AS notes FROM f")(
    lambda s, d: _snapshots(s, d).select("opportunity_id", S.methodology(F.col("score"), F.col("signals"), AS_OF).alias("notes"))
)
_per_title("opportunity_filter_flag", lambda: S.is_opportunity(T(), F.col("source")), f"source IN ('hackernews', 'github') OR {_any('lower(title)', R.OPPORTUNITY_KEYWORDS)}", "kept")
query("opportunity_filter", f"{W} SELECT id, title FROM titles WHERE source IN ('hackernews', 'github') OR {_any('lower(title)', R.OPPORTUNITY_KEYWORDS)}")(lambda s, d: titles(s, d).filter(S.is_opportunity(T(), F.col("source"))).select("id", "title"))
query("html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", S.html_escape(F.col("html")).alias("escaped")))
query("strip_tags", "SELECT page_id, substr(trim(regexp_replace(html, '<[^>]*>', '', 'g')), 1, 100) AS plain FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", S.strip_tags(F.col("html")).alias("plain")))
query("email_valid", "SELECT s_suppkey, regexp_matches(m, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name || '@example.org' WHEN 1 THEN replace(s_name, '#', '') || '@x.io y' ELSE s_name END AS m FROM supplier)")(
    lambda s, d: table(s, d, "supplier").select("s_suppkey", S.email_valid(F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("@example.org"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.replace("s_name", F.lit("#"), F.lit("")), F.lit("@x.io y"))).otherwise(F.col("s_name"))).alias("valid"))
)
query("is_rate_limit_error", f"{W} SELECT id, contains(m, '429') OR contains(m, 'RATELIMIT_EXCEEDED') OR contains(lower(m), 'quota') OR contains(lower(m), 'rate limit') AS limited FROM (SELECT id, title || ['', ' HTTP 429', ' Quota hit', ' Rate limit', ' RATELIMIT_EXCEEDED'][1 + id % 5] AS m FROM titles)")(
    lambda s, d: titles(s, d).select("id", S.is_rate_limit_error(F.concat("title", F.get(F.array(*map(F.lit, ("", " HTTP 429", " Quota hit", " Rate limit", " RATELIMIT_EXCEEDED"))), (F.col("id") % 5).cast("int")))).alias("limited"))
)
query("edit_distance", "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")(
    lambda s, d: edit_distances(table(s, d, "part"), ["p_brand", "p_size"], "p_partkey", F.col("p_name")).select("a", "b", "distance")
)
query("edit_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(CASE WHEN lower(a.p_name) = lower(b.p_name) THEN 1.0 ELSE (greatest(length(a.p_name), length(b.p_name)) - levenshtein(lower(trim(a.p_name)), lower(trim(b.p_name)))) / greatest(length(a.p_name), length(b.p_name)) END, 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")(
    lambda s, d: edit_distances(table(s, d, "part"), ["p_brand", "p_size"], "p_partkey", F.lower(S.strip(F.col("p_name")))).select("a", "b", F.round(S.share_kept(F.col("distance"), F.col("longest")), 6).alias("similarity"))
)


# ---------------------------------------------------------------- scores of single rows

query("age_days", f"{W} SELECT id, round({AGE}, 6) AS age, CAST(floor({AGE}) AS BIGINT) AS days FROM titles")(lambda s, d: titles(s, d).select("id", F.round(S.age_days(F.col("created_at"), AS_OF), 6).alias("age"), F.floor(S.age_days(F.col("created_at"), AS_OF)).alias("days")))
query("utc_day", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.to_date("ts").alias("day")))
query("interval_cutoffs", f"{W} SELECT id, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS week, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS fortnight, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AS recent, created_at >= date_trunc('month', TIMESTAMP '{AS_OF}') AS month FROM titles")(
    lambda s, d: titles(s, d).select("id", (F.col("created_at") >= S.days_before(AS_OF, 7)).alias("week"), (F.col("created_at") >= S.days_before(AS_OF, 14)).alias("fortnight"), (F.col("created_at") >= S.days_before(AS_OF, 3)).alias("recent"), (F.col("created_at") >= F.date_trunc("month", S.moment(AS_OF))).alias("month"))
)
query("lead_time_days", f"SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2001-06-01') - epoch_us(o_orderdate)) / 86400e6) AS BIGINT) AS lead_time_days FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.floor(S.age_days(F.col("o_orderdate"), "2001-06-01")).alias("lead_time_days")))
query("hours_remaining", f"{W} SELECT id, greatest(0, CAST(floor((epoch_us(created_at + INTERVAL 72 HOUR) - epoch_us(TIMESTAMP '{AS_OF}')) / 3600e6) AS BIGINT)) AS hours FROM titles")(
    lambda s, d: titles(s, d).select("id", F.greatest(F.lit(0), F.floor(72 - 24 * S.age_days(F.col("created_at"), AS_OF))).cast("bigint").alias("hours"))
)
query("epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz"))
)
_first = lambda word: f"upper(substr({word}, 1, 1)) || substr({word}, 2)"
_named = lambda d, x: "CASE " + x + " " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in d.items()) + " END"
query(
    "compose_trend_name",
    f"""{W}, t AS (SELECT id, keywords[1] AS k, lower(trim(regexp_replace(regexp_replace(title, '^(show hn|ask hn|tell hn):?', '', 'i'), '\\[.*?\\]', '', 'g'))) AS low FROM titles),
    q AS (SELECT id, coalesce({_named(R.CATEGORY_PREFIXES, "k")}, CASE k WHEN '' THEN '' WHEN 'ai' THEN 'AI' WHEN 'ai agents' THEN 'AI Agents' ELSE {_first("k")} END) AS prefix,
      string_split_regex(trim(CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN regexp_extract(low, '{p}', 1)" for p in R.QUALIFIER_PATTERNS)} END), '\\s+')[1:3] AS w FROM t)
    SELECT id, CASE WHEN coalesce(array_to_string(w, ' '), '') = '' THEN prefix WHEN {_named(R.QUALIFIERS, "array_to_string(w, ' ')")} IS NOT NULL THEN prefix || ' for ' || {_named(R.QUALIFIERS, "array_to_string(w, ' ')")}
      WHEN list_contains({sql_list(R.NOISE_WORDS)}, w[1]) THEN prefix WHEN array_to_string(w, ' ') = 'ai' THEN prefix || ' for AI' WHEN array_to_string(w, ' ') = 'ai agents' THEN prefix || ' for AI Agents' ELSE prefix || ' for ' || {_first("array_to_string(w, ' ')")} END AS name FROM q""",
)(lambda s, d: titles(s, d).select("id", S.trend_name(F.get("keywords", 0), T()).alias("name")))
query("epoch_s", "SELECT event_id, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS ts FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("timestamp_ntz").alias("ts")))
_JS = lambda e: f"CAST(floor({e} + 0.5) AS BIGINT)"
query("score_reddit", f"{W} SELECT id, {_JS(f'least(100.0, (score / 100 * 0.6 + engagement / 50 * 0.4) * (1 + 0.3 * greatest(0.0, 1 - {AGE} / 7)))')} AS s FROM titles")(lambda s, d: titles(s, d).select("id", S.score_reddit(F.col("score"), F.col("engagement"), S.age_days(F.col("created_at"), AS_OF)).alias("s")))
query("score_hn", f"{W} SELECT id, {_JS(f'least(100.0, (score / 500 * 0.6 + engagement / 200 * 0.4 + (1 - (id % 30) / 30) * 0.5) * (1 + 0.2 * greatest(0.0, 1 - {AGE})))')} AS s FROM titles")(lambda s, d: titles(s, d).select("id", S.score_hackernews(F.col("score"), F.col("engagement"), F.col("id") % 30, S.age_days(F.col("created_at"), AS_OF)).alias("s")))
query("score_ph", f"{W} SELECT id, {_JS(f'least(100.0, (least(100.0, score / 10) + (1 - (id % 30) / 30) * 0.4 * 50) * (1 + 0.2 * greatest(0.0, 1 - {AGE} / 7)))')} AS s FROM titles")(lambda s, d: titles(s, d).select("id", S.score_producthunt(F.col("score"), F.col("id") % 30, S.age_days(F.col("created_at"), AS_OF)).alias("s")))
query("score_github", "SELECT p_partkey, CASE WHEN n >= 10000 THEN 95 WHEN n >= 5000 THEN 85 WHEN n >= 1000 THEN 70 WHEN n >= 500 THEN 55 WHEN n >= 100 THEN 40 ELSE 25 END AS s FROM (SELECT p_partkey, p_size * p_size * 5 AS n FROM part)")(lambda s, d: table(s, d, "part").select("p_partkey", S.score_github(F.col("p_size") * F.col("p_size") * 5).alias("s")))
_COMP = f"least(40.0, engagement / 1000 * 40) + least(30.0, 0.3 * score) + greatest(0.0, 20 - 2 * {AGE}) + CASE WHEN id % 5 > 0 THEN least(10, 3 * (id % 5)) ELSE 0 END"
_comp = lambda: S.composite_score(F.col("engagement"), F.col("score"), S.age_days(F.col("created_at"), AS_OF), F.col("id") % 5)
query("composite_score", f"{W} SELECT id, round({_COMP}, 6) AS s FROM titles")(lambda s, d: titles(s, d).select("id", F.round(_comp(), 6).alias("s")))
query("top_signals", f"{W} SELECT id, round({_COMP}, 6) AS s FROM titles ORDER BY s DESC, id LIMIT 20")(lambda s, d: titles(s, d).select("id", F.round(_comp(), 6).alias("s")).orderBy(F.desc("s"), "id").limit(20))
query("frequency_score", f"SELECT p_partkey, {_JS('least(p_size, 50) / 50 * 100')} AS s FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.frequency_score(F.col("p_size")).alias("s")))
query("recency_score", f"{W} SELECT id, {_JS(f'greatest(0.0, least(100.0, 100 * exp(-0.1 * {AGE})))')} AS s FROM titles")(lambda s, d: titles(s, d).select("id", S.recency_score(S.age_days(F.col("created_at"), AS_OF)).alias("s")))
query("opportunity_label", f"SELECT p_partkey, CASE WHEN p_size * 2 >= 80 THEN 'High' WHEN p_size * 2 >= 60 THEN 'Watch' WHEN p_size * 2 >= 40 THEN 'Emerging' ELSE 'Noise' END AS label FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.opportunity_label(F.col("p_size") * 2).alias("label")))
_WEIGHT = f"CASE WHEN source = 'hackernews' AND {_rlike('title', '^ask hn')} THEN 1.4 WHEN source = 'hackernews' AND {_rlike('title', '^show hn')} THEN 1.1 WHEN source = 'hackernews' THEN 0.9 WHEN source = 'reddit' THEN 0.6 WHEN source = 'producthunt' THEN 1.2 ELSE 1.0 END"
query("source_weight", f"{W} SELECT id, CAST({_WEIGHT} AS DOUBLE) AS weight FROM titles")(lambda s, d: titles(s, d).select("id", S.source_weight(F.col("source"), T()).alias("weight")))
_INT = _case((f"c = '{k}'", v) for k, v in R.PAIN_INTENSITY.items()).replace("ELSE NULL", f"ELSE {R.OTHER_INTENSITY}")
_GAP = _case([*((f"c = '{k}'", v) for k, v in R.GAP_BY_CLASS.items()), (f"c = 'request' AND {_rlike('title', R.STRONG_REQUEST)}", R.STRONG_REQUEST_GAP)], str(R.OTHER_GAP))
_OPP = f"""{W}, c AS (SELECT *, {_CLASS} AS c FROM titles),
  kw AS (SELECT lower(k) AS k, count(*) AS n FROM (SELECT DISTINCT id, unnest(keywords) AS k FROM titles WHERE {AGE} < 8) GROUP BY 1),
  o AS (SELECT c.*, {_INT} AS pain_intensity, least(coalesce(kw.n, 0) * 5, 25) AS demand_recurrence, {_GAP} AS market_gap, least({_JS('engagement / 10')}, 15) AS engagement_depth,
    CASE WHEN regexp_matches(lower(title || ' ' || array_to_string(keywords, ' ')), '\\b({R.BUSINESS_TERMS})\\b') THEN 10 ELSE 4 END AS monetization_fit, {_WEIGHT} AS w FROM c LEFT JOIN kw ON kw.k = lower(keywords[1])),
  scored AS (SELECT *, least(100, {_JS('CAST((pain_intensity + demand_recurrence + market_gap + engagement_depth + monetization_fit) AS DOUBLE) * CAST(w AS DOUBLE)')}) AS final_score FROM o) """


def opportunity_scores(s, d):
    """Signals with the parts of their opportunity score."""
    t = titles(s, d)
    recent = t.filter(F.floor(S.age_days(F.col("created_at"), AS_OF)) <= 7)
    recurring = recent.select("id", F.explode(F.array_distinct("keywords")).alias("k")).groupBy(F.lower("k").alias("k")).agg(F.count("*").alias("n"))
    parts = S.opportunity_parts(T(), F.col("engagement"), F.col("keywords"), F.coalesce("n", F.lit(0)))
    joined = t.join(recurring, F.lower(F.get("keywords", 0)) == F.col("k"), "left").drop("k")
    made = joined.withColumns(parts)
    raw = F.col("pain_intensity") + F.col("demand_recurrence") + F.col("market_gap") + F.col("engagement_depth") + F.col("monetization_fit")
    return made.withColumn("final_score", F.least(F.lit(100), S.js_round(raw * S.source_weight(F.col("source"), T()))))


_PARTS = "id, c AS pain_class, pain_intensity, demand_recurrence, market_gap, engagement_depth, monetization_fit, final_score"
query("opportunity_score", f"{_OPP} SELECT {_PARTS} FROM scored")(lambda s, d: opportunity_scores(s, d).select("id", "pain_class", "pain_intensity", "demand_recurrence", "market_gap", "engagement_depth", "monetization_fit", "final_score"))
query("agg_demand_recurrence", f"{_OPP} SELECT id, demand_recurrence FROM scored")(lambda s, d: opportunity_scores(s, d).select("id", "demand_recurrence"))
query("noise_filter", f"{_OPP} SELECT id, final_score FROM scored WHERE final_score >= 40")(lambda s, d: opportunity_scores(s, d).filter(S.opportunity_label(F.col("final_score")) != "Noise").select("id", "final_score"))
query("confidence_gate", f"{_OPP} SELECT id, final_score FROM scored WHERE final_score >= 25")(lambda s, d: opportunity_scores(s, d).filter("final_score >= 25").select("id", "final_score"))
query("agg_score_range", f"{_OPP} SELECT min(final_score) AS lo, max(final_score) AS hi FROM scored")(lambda s, d: opportunity_scores(s, d).agg(F.min("final_score").alias("lo"), F.max("final_score").alias("hi")))
_FACT = {
    "base": "5", "soUnsolvedQuestion": "0", "soHighScore": "0", "hnHighScore": "CASE WHEN source = 'hackernews' AND score > 100 THEN 1 ELSE 0 END",
    "ghHighScore": "CASE WHEN source = 'github' AND score > 500 THEN 1 ELSE 0 END", "longTitle": "CASE WHEN length(title) > 40 THEN 1 ELSE 0 END", "substantialBody": "0",
    "keywordInTitle": "CASE WHEN keywords[1] <> '' AND contains(lower(title), lower(keywords[1])) THEN 1 ELSE 0 END", "noiseTerms": f"CASE WHEN {_any('lower(title)', R.NOISE_TERMS)} THEN -2 ELSE 0 END", "lowEngagement": "CASE WHEN score < 5 THEN -1 ELSE 0 END",
}


def _factors():
    return S.quality_factors(F.col("source"), T(), F.lit(None).cast("string"), F.get("keywords", 0), F.col("score"), F.lit(0))


query("quality_score", f"{W} SELECT id, CAST(greatest(1, least(10, {' + '.join(_FACT.values())})) AS INT) AS quality FROM titles")(lambda s, d: titles(s, d).select("id", S.quality_score(_factors()).alias("quality")))
query("quality_factors", f"{W} SELECT id, factor, v FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS factor, {v} AS v FROM titles" for k, v in _FACT.items()) + ") WHERE v <> 0")(
    lambda s, d: titles(s, d).select("id", F.explode(F.map_filter(F.create_map(*[x for k, v in _factors().items() for x in (F.lit(k), v)]), lambda k, v: v != 0)).alias("factor", "v"))
)
query("enrich_signals", f"{W} SELECT id, CASE WHEN id % 2 = 0 THEN CAST(greatest(1, least(10, {' + '.join(_FACT.values())})) AS INT) ELSE 7 END AS quality FROM titles")(lambda s, d: titles(s, d).select("id", F.when(F.col("id") % 2 == 0, S.quality_score(_factors())).otherwise(7).alias("quality")))
query("window_estimate", "SELECT p_partkey, CASE WHEN p_size > 20 THEN '3-6 months' WHEN p_size > 10 THEN '6-12 months' WHEN p_size > 5 THEN '12-18 months' ELSE '18-24 months' END AS w FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.window_estimate(F.col("p_size")).alias("w")))
query("score_band", "SELECT p_partkey, CASE WHEN p_size * 2 < 25 THEN 'emerging' WHEN p_size * 2 < 60 THEN 'rising' WHEN p_size * 2 < 85 THEN 'peaking' ELSE 'declining' END AS band FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.score_band(F.col("p_size") * 2).alias("band")))
query("card_score", f"SELECT p_partkey, least(greatest({_JS('p_size * 2.0 - 5 * (p_partkey % 9)')}, 0), 100) AS card FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", S.card_score(F.col("p_size") * 2.0, F.col("p_partkey") % 9).alias("card")))
query("cluster_confidence", "SELECT p_partkey, round(least(100.0, 100 * (0.4 * least(p_size / 100, 1.0) + 0.3 * least((p_partkey % 70) / 50, 1.0) + 0.2 * least((p_partkey % 7) / 5, 1.0) + 0.1 * least((p_partkey % 30) / 20, 1.0))), 6) AS confidence FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(S.cluster_confidence(F.col("p_size"), F.col("p_partkey") % 70, F.col("p_partkey") % 7, F.col("p_partkey") % 30), 6).alias("confidence"))
)
query("pain_mapping", f"SELECT * FROM (WITH {TITLES_SQL}, p AS (SELECT id, {_case((_rlike('title', p), _q(k)) for k, p in R.FEED_PAINS['reddit'].items())} AS pain FROM titles) SELECT id, {_case((f'contains(lower(coalesce(pain, {chr(39)}{chr(39)})), lower({_q(k)}))', _q(v[0])) for k, v in R.MONETIZATION.items()).replace('ELSE NULL', 'ELSE ' + _q(R.OTHER_MONETIZATION[0]))} AS monetization, CAST({_case((f'contains(lower(coalesce(pain, {chr(39)}{chr(39)})), lower({_q(k)}))', v[1]) for k, v in R.MONETIZATION.items()).replace('ELSE NULL', 'ELSE 5')} AS INT) AS difficulty FROM p)")(
    lambda s, d: titles(s, d).select("id", *[c.alias(n) for c, n in zip(S.pain_mapping(S.feed_pain(T(), "reddit")), ("monetization", "difficulty"), strict=True)])
)
query("target_market", f"{W} SELECT id, {_case((_any('lower(title)', w), _q(t)) for w, t in R.TARGET_MARKETS).replace('ELSE NULL', 'ELSE ' + _q(R.OTHER_MARKET))} AS market FROM titles")(lambda s, d: titles(s, d).select("id", S.target_market(F.split("title", " ")).alias("market")))
query("pain_point_text", f"{W} SELECT id, {_case(((_any('lower(title)', w), _q(t)) for w, t in R.CLUSTER_PAINS), _q('Current solutions for ') + ' || lower(title) || ' + _q(' are fragmented, difficult to integrate, and fail to meet evolving team needs.'))} AS pain FROM titles")(lambda s, d: titles(s, d).select("id", S.cluster_pain(T(), F.split("title", " ")).alias("pain")))
_WHY = R.WHY_NOW
query(
    "why_now",
    f"SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 15 THEN {_q(_WHY['velocity'][0][1])} WHEN p_size > 8 THEN {_q(_WHY['velocity'][1][1])} END, CASE WHEN p_partkey % 6 >= 4 THEN {_q(_WHY['diversity'][0][1])} WHEN p_partkey % 6 >= 3 THEN {_q(_WHY['diversity'][1][1])} END, CASE WHEN p_size * 2 > 60 THEN {_q(_WHY['score'][0][1])} WHEN p_size * 2 > 45 THEN {_q(_WHY['score'][1][1])} END, CASE WHEN p_partkey % 11 > 5 THEN {_q(_WHY['concepts'][0])} ELSE {_q(_WHY['concepts'][1])} END], lambda x: x IS NOT NULL), '. ') || '.' AS why FROM part",
)(lambda s, d: table(s, d, "part").select("p_partkey", S.why_now(F.col("p_size"), F.col("p_partkey") % 6, F.col("p_size") * 2, F.col("p_partkey") % 11).alias("why")))
