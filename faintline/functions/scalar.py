"""Scalar functions as Columns: text, rules, time, scores. All stay inside Spark's generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faintline.functions import rules as R


def js_round(c: Column) -> Column:
    """Round half up, towards plus infinity, as a whole number."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_contained(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def first_rule(rules, otherwise: Column | None = None) -> Column:
    """Of (condition, value) pairs the first that holds."""
    out = None
    for when, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, value) if out is None else out.when(when, value)
    return out if otherwise is None else out.otherwise(otherwise)


# ---------------------------------------------------------------- text


def strip(text: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]++|[\s\p{Z}\x{FEFF}]++$", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_normalize(raw: Column) -> Column:
    """A title without feed prefix and trailing clause, or null where too little is left."""
    t = strip(raw)
    for p in R.TITLE_PREFIXES:
        t = F.regexp_replace(t, rf"(?i)^{p}\s*", "")
    cut = F.regexp_instr(t, F.lit("[?|–—]"))
    t = F.when(cut > 11, F.substr(t, F.lit(1), cut - 1)).otherwise(t)
    t = strip(F.regexp_replace(t, r"[,.:\s]+$", ""))
    t = F.regexp_replace(t, r"\s+", " ")
    tokens = F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", ""), r"\s+")
    meaningful = F.size(F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(R.WEAK_TITLE_TOKENS)))
    return F.when((F.length(t) >= 12) & (meaningful >= 2), t)


def concept_tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), "-+", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= 3)


def ngram_concepts(text: Column) -> Column:
    """Concepts of a text: at each place trigram, bigram and unigram free of stop words; distinct, in that order."""
    stop = lambda t: t.isin(R.CONCEPT_STOPWORDS)

    def at(tokens: Column, i: Column) -> Column:
        a, b, c = F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)
        three = F.when(c.isNotNull() & ~stop(a) & ~stop(b) & ~stop(c), F.concat_ws(" ", a, b, c))
        two = F.when(b.isNotNull() & ~stop(a) & ~stop(b), F.concat_ws(" ", a, b))
        one = F.when(~stop(a) & (a.isin(R.TECHNICAL_TERMS) | (F.length(a) >= 4)), a)
        return F.array(three, two, one)

    def all_of(tokens: Column) -> Column:
        return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: at(tokens, i)))))

    none = F.array().cast("array<string>")
    return F.element_at(F.transform(F.array(concept_tokens(text)), lambda tokens: F.when(F.size(tokens) > 0, all_of(tokens)).otherwise(none)), 1)


def bigrams(text: Column) -> Column:
    """Neighbours among the words left after stop words went."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(R.OPPORTUNITY_STOPWORDS))
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.element_at(F.transform(F.array(words), pairs), 1)


def dedupe_tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(R.OPPORTUNITY_STOPWORDS)))


def edit_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return share_kept(F.levenshtein(x, y), F.greatest(F.length(x), F.length(y)))


def share_kept(distance: Column, longest: Column) -> Column:
    """Similarity of two texts by their edit distance and the greater length."""
    return F.when(distance == 0, F.lit(1.0)).otherwise((longest - distance) / F.greatest(longest, F.lit(1)))


def feed_keywords(text: Column, feed: str) -> Column:
    """The first eight distinct keywords, group by group."""
    found = [F.regexp_extract_all(text, F.lit(rf"(?i)\b({p})\b"), F.lit(0)) for p in R.FEED_KEYWORDS[feed]]
    return F.slice(F.array_distinct(F.transform(F.concat(*found), F.lower)), 1, R.MOST_KEYWORDS)


def feed_pain(text: Column, feed: str) -> Column:
    return first_rule((text.rlike(f"(?i){p}"), pain) for pain, p in R.FEED_PAINS[feed].items())


def pain_class(title: Column) -> Column:
    return first_rule((title.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), name) for name, patterns in R.PAIN_CLASSES.items())


def gap_type(title: Column) -> Column:
    return first_rule((contains_any(F.lower(title), words), name) for name, words in R.GAP_TYPES.items())


def canonical_trend(title: Column) -> Column:
    """The trend with most keywords in the title; of equals the first; null without any."""
    low = F.lower(title)
    scores = [F.struct(count_contained(low, words).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(R.TRENDS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"])


def is_opportunity(title: Column, source: Column) -> Column:
    return source.isin(*R.ALWAYS_KEPT_SOURCES) | contains_any(F.lower(title), R.OPPORTUNITY_KEYWORDS)


def capitalize(text: Column) -> Column:
    return first_rule([(text == "", text), (text == "ai", "AI"), (text == "ai agents", "AI Agents")], F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))


def trend_name(keyword: Column, title: Column) -> Column:
    """A trend's name: its category, and what or whom the title says it is for."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    prefix = F.coalesce(F.element_at(pairs(R.CATEGORY_PREFIXES), keyword), capitalize(keyword))
    low = F.lower(strip(F.regexp_replace(F.regexp_replace(title, r"(?i)^(show hn|ask hn|tell hn):?", ""), r"\[.*?\]", "")))
    found = F.coalesce(*[F.when(low.rlike(p), F.regexp_extract(low, p, 1)) for p in R.QUALIFIER_PATTERNS])
    words = F.slice(F.split(strip(found), r"\s+"), 1, 3)
    short = F.array_join(words, " ")
    known = F.element_at(pairs(R.QUALIFIERS), short)
    named = F.when(known.isNotNull(), F.concat(prefix, F.lit(" for "), known)).when(F.get(words, 0).isin(*R.NOISE_WORDS), prefix)
    return F.when(F.coalesce(short, F.lit("")) == "", prefix).otherwise(named.otherwise(F.concat(prefix, F.lit(" for "), capitalize(short))))


def proper_nouns(title: Column) -> Column:
    """The words of a title that begin with a capital, in small letters and digits alone; once per title, however many words are asked for."""
    cleaned = F.transform(F.filter(F.split(title, r"\s+"), lambda w: F.length(w) >= 3), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    capital = lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))
    return F.transform(F.filter(cleaned, capital), F.lower)


def is_proper_noun(word: Column, title: Column) -> Column:
    return F.exists(proper_nouns(title), lambda w: w == word)


def primary_keyword(title: Column, keywords: Column, topic: str | None = None) -> Column:
    low = F.lower(title)
    category = first_rule((low.contains(c), c) for c in R.CATEGORIES)

    def scored(k: Column, i: Column) -> Column:
        score = F.when(k.isin(R.CATEGORIES), 20).otherwise(0) + F.when(is_proper_noun(k, title), -50).otherwise(0) + F.length(k)
        return F.struct(score.alias("score"), (-i).alias("place"), k.alias("k"))

    usable = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: (F.length(k) >= 3) & ~k.isin(R.OPPORTUNITY_STOPWORDS))
    best = F.array_max(F.filter(F.transform(usable, scored), lambda s: s["score"] > 0))["k"]
    safe = F.get(F.filter(bigrams(title), lambda b: ~F.exists(F.split(b, " "), lambda w: is_proper_noun(w, title))), 0)
    hint = F.lit(topic.lower().strip()) if topic and topic.strip() else F.lit(None).cast("string")
    fallback = F.get(F.array(*map(F.lit, R.FALLBACK_KEYWORDS)), F.length(title) % len(R.FALLBACK_KEYWORDS))
    return F.coalesce(category, best, safe, hint, fallback)


def topic_rank(title: Column, pain: Column, keywords: Column, score: Column, topic: str) -> Column:
    """The score, raised by where the topic and its words are found; 0 where nowhere. The topic's words are unrolled."""
    q = topic.strip().lower()
    joined = F.array_join(F.array_distinct(F.transform(keywords, F.lower)), " ")
    places = ((F.lower(title), 60, 15), (F.lower(F.coalesce(pain, F.lit(""))), 30, 10), (joined, 40, 12))
    bonus = F.lit(0)
    for text, whole, part in places:
        bonus = bonus + F.when(text.contains(q), whole).otherwise(0)
        for term in (t for t in q.split() if len(t) >= 3):
            bonus = bonus + F.when(text.contains(term), part).otherwise(0)
    return F.when(bonus == 0, 0).otherwise(score + bonus)


def agent_pain(title: Column, keyword: Column) -> Column:
    low = F.lower(title)
    return first_rule(((contains_any(low, words), text) for words, text in R.AGENT_PAINS), F.concat(F.lit("managing "), keyword, F.lit(" workflows efficiently")))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_tags(text: Column, most: int = 100) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "<[^>]*>", "")), 1, most)


def cluster_label(concepts: Column) -> Column:
    n = F.size(concepts)
    rest = F.array_join(F.slice(concepts, 2, 2), ", ")
    return first_rule([(n == 0, "Unnamed Cluster"), (n == 1, F.get(concepts, 0)), (n == 2, F.concat_ws(" & ", F.get(concepts, 0), F.get(concepts, 1)))], F.concat(F.get(concepts, 0), F.lit(" + "), rest))


def email_valid(text: Column) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_rate_limit_error(message: Column) -> Column:
    return message.contains(R.RATE_LIMIT_MARKS[0]) | message.contains(R.RATE_LIMIT_MARKS[1]) | contains_any(F.lower(message), R.RATE_LIMIT_MARKS[2:])


# ---------------------------------------------------------------- time


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def age_days(ts: Column, as_of: str) -> Column:
    return (F.unix_micros(moment(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400e6)


def days_before(as_of: str, days: float) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL '{int(days * 24)}' HOUR")


# ---------------------------------------------------------------- scores


def score_reddit(score: Column, comments: Column, age: Column) -> Column:
    fresh = 1 + 0.3 * F.greatest(F.lit(0.0), 1 - age / 7)
    return js_round(F.least(F.lit(100.0), (score / 100 * 0.6 + comments / 50 * 0.4) * fresh))


def score_hackernews(score: Column, comments: Column, place: Column, age: Column) -> Column:
    fresh = 1 + 0.2 * F.greatest(F.lit(0.0), 1 - age)
    return js_round(F.least(F.lit(100.0), (score / 500 * 0.6 + F.coalesce(comments, F.lit(0)) / 200 * 0.4 + (1 - place / 30) * 0.5) * fresh))


def score_producthunt(votes: Column, place: Column, age: Column) -> Column:
    fresh = 1 + 0.2 * F.greatest(F.lit(0.0), 1 - age / 7)
    return js_round(F.least(F.lit(100.0), (F.least(F.lit(100.0), votes / 10) + (1 - place / 30) * 0.4 * 50) * fresh))


def score_github(stars: Column) -> Column:
    return first_rule([(stars >= n, s) for n, s in ((10000, 95), (5000, 85), (1000, 70), (500, 55), (100, 40))], F.lit(25))


def composite_score(engagement: Column, source_score: Column, age: Column, duplicates: Column) -> Column:
    parts = F.least(F.lit(40.0), engagement / 1000 * 40) + F.least(F.lit(30.0), 0.3 * source_score) + F.greatest(F.lit(0.0), 20 - 2 * age)
    return parts + F.when(duplicates > 0, F.least(F.lit(10), 3 * duplicates)).otherwise(0)


def frequency_score(mentions: Column) -> Column:
    return js_round(F.least(mentions, F.lit(50)) / 50 * 100)


def velocity_score(recent: Column, previous: Column) -> Column:
    new = F.when(recent > 0, F.least(0.5 * recent, F.lit(5.0))).otherwise(0.0)
    return F.when(previous == 0, new).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(10.0), (recent - previous) / F.greatest(previous, F.lit(1)))))


def diversity_score(distribution: Column) -> Column:
    """Number of sources over four, and how evenly mentions spread over them. distribution: a map of counts."""
    n, counts = F.size(distribution), F.map_values(distribution)
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    share = lambda x: F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0)
    entropy = -F.aggregate(counts, F.lit(0.0), lambda a, x: a + share(x))
    return js_round(n / 4 * 70 + F.when((total > 0) & (n > 1), entropy / F.log2(n.cast("double")) * 30).otherwise(0.0))


def recency_score(age: Column) -> Column:
    return F.coalesce(js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.exp(-0.1 * age)))), F.lit(0))


def cooccurrence_score(degree: Column) -> Column:
    return js_round(F.least(degree, F.lit(20)) / 20 * 100)


def weak_signal_score(frequency: Column, velocity: Column, diversity: Column, recency: Column, cooccurrence: Column) -> Column:
    speed = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 10 * velocity))
    mixed = 0.25 * frequency + 0.30 * speed + 0.20 * diversity + 0.15 * recency + 0.10 * cooccurrence
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mixed)))


def source_weight(source: Column, title: Column, subreddit: Column | None = None) -> Column:
    """How much a source counts; where a subreddit is known, communities of businesses count more."""
    src = F.lower(source)
    business = F.lit(False) if subreddit is None else subreddit.rlike("(?i)entrepreneur|saas|startups|indiehackers|devops|sysadmin")
    hn = src.contains("hackernews")
    rules = [(hn & title.rlike("(?i)^ask hn"), 1.4), (hn & title.rlike("(?i)^show hn"), 1.1), (hn, 0.9), (src.contains("reddit") & business, 1.3), (src.contains("reddit"), 0.6), (src.contains("producthunt"), 1.2)]
    return first_rule(rules, F.lit(1.0))


def opportunity_parts(title: Column, engagement: Column, keywords: Column, recurrence: Column) -> dict[str, Column]:
    kind = pain_class(title)
    pain = first_rule([(kind == k, v) for k, v in R.PAIN_INTENSITY.items()], F.lit(R.OTHER_INTENSITY))
    by_class = [(kind == k, v) for k, v in R.GAP_BY_CLASS.items()]
    gap = first_rule([*by_class, ((kind == "request") & title.rlike(f"(?i){R.STRONG_REQUEST}"), R.STRONG_REQUEST_GAP)], F.lit(R.OTHER_GAP))
    text = F.lower(F.concat(title, F.lit(" "), F.array_join(keywords, " ")))
    return {
        "pain_class": kind,
        "pain_intensity": pain,
        "demand_recurrence": F.least(recurrence * 5, F.lit(25)),
        "market_gap": gap,
        "engagement_depth": F.least(js_round(engagement / 10), F.lit(15)),
        "monetization_fit": F.when(text.rlike(rf"\b({R.BUSINESS_TERMS})\b"), 10).otherwise(4),
    }


def opportunity_label(score: Column) -> Column:
    return first_rule([(score >= 80, "High"), (score >= 60, "Watch"), (score >= 40, "Emerging")], F.lit("Noise"))


def quality_factors(source: Column, title: Column, body: Column, keyword: Column, score: Column, comments: Column) -> dict[str, Column]:
    """What raises or lowers the quality of a signal; 0 where a factor doesn't apply."""
    low = F.lower(title)
    when = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    return {
        "base": F.lit(5),
        "soUnsolvedQuestion": when((source == "stackoverflow") & (comments == 0), 2),
        "soHighScore": when((source == "stackoverflow") & (score > 50), 1),
        "hnHighScore": when((source == "hackernews") & (score > 100), 1),
        "ghHighScore": when((source == "github") & (score > 500), 1),
        "longTitle": when(F.length(title) > 40, 1),
        "substantialBody": when(F.length(body) > 200, 1),
        "keywordInTitle": when((keyword != "") & low.contains(F.lower(keyword)), 1),
        "noiseTerms": when(contains_any(low, R.NOISE_TERMS), -2),
        "lowEngagement": when(score < 5, -1),
    }


def quality_score(factors: dict[str, Column]) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), reduce(lambda a, b: a + b, factors.values())))


def cluster_confidence(score: Column, velocity: Column, diversity: Column, mentions: Column) -> Column:
    part = lambda c, most: F.least(c / most, F.lit(1.0))
    return F.least(F.lit(100.0), 100 * (0.4 * part(score, 100) + 0.3 * part(velocity, 50) + 0.2 * part(diversity, 5) + 0.1 * part(mentions, 20)))


def window_estimate(velocity: Column) -> Column:
    return first_rule([(velocity > v, w) for v, w in ((20, "3-6 months"), (10, "6-12 months"), (5, "12-18 months"))], F.lit("18-24 months"))


def keyword_velocity_status(last7: Column, last14: Column) -> Column:
    return first_rule([(last7 > last14 / 2, "accelerating"), (last7 == js_round(last14 / 2), "peaking")], F.lit("fading"))


def card_score(market: Column, difficulty: Column) -> Column:
    return F.least(F.greatest(js_round(market - 5 * difficulty), F.lit(0)), F.lit(100))


def score_band(score: Column) -> Column:
    return first_rule([(score < 25, "emerging"), (score < 60, "rising"), (score < 85, "peaking")], F.lit("declining"))


def pain_mapping(pain: Column) -> tuple[Column, Column]:
    """(monetization, difficulty) of the first known pain within a text."""
    low = F.lower(F.trim(F.coalesce(pain, F.lit(""))))
    rows = [(low.contains(k.lower()), v) for k, v in R.MONETIZATION.items()]
    return first_rule([(c, v[0]) for c, v in rows], F.lit(R.OTHER_MONETIZATION[0])), first_rule([(c, v[1]) for c, v in rows], F.lit(R.OTHER_MONETIZATION[1]))


def target_market(concepts: Column) -> Column:
    any_of = lambda words: F.exists(concepts, lambda c: contains_any(F.lower(c), words))
    return first_rule(((any_of(words), text) for words, text in R.TARGET_MARKETS), F.lit(R.OTHER_MARKET))


def cluster_pain(label: Column, concepts: Column) -> Column:
    low = F.lower(label)
    first, text = R.CLUSTER_PAINS[0]
    rows = [(contains_any(low, first) | F.exists(concepts, lambda c: contains_any(F.lower(c), first)), text)]
    rows += [(contains_any(low, words), text) for words, text in R.CLUSTER_PAINS[1:]]
    return first_rule(rows, F.concat(F.lit("Current solutions for "), low, F.lit(" are fragmented, difficult to integrate, and fail to meet evolving team needs.")))


def why_now(velocity: Column, diversity: Column, score: Column, members: Column) -> Column:
    (v1, v2), (d1, d2), (s1, s2) = R.WHY_NOW["velocity"], R.WHY_NOW["diversity"], R.WHY_NOW["score"]
    many, few = R.WHY_NOW["concepts"]
    parts = [
        first_rule([(velocity > v1[0], v1[1]), (velocity > v2[0], v2[1])]),
        first_rule([(diversity >= d1[0], d1[1]), (diversity >= d2[0], d2[1])]),
        first_rule([(score > s1[0], s1[1]), (score > s2[0], s2[1])]),
        F.when(members > 5, many).otherwise(few),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), ". "), F.lit("."))


def filled(template: str, **values: Column) -> Column:
    """A text with columns in place of its names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def methodology(score: Column, signals: Column, at: str) -> Column:
    """Notes on how a prediction came about. signals: array of structs (source, title, score, comments), in order."""
    sources = F.array_join(F.array_distinct(F.transform(signals, lambda s: s["source"])), ", ")
    line = lambda s, i: filled(R.SIGNAL_LINE, place=i + 1, source=F.upper(s["source"]), title=s["title"], score=s["score"], comments=s["comments"])
    return filled(R.METHODOLOGY, score=score, count=F.size(signals), sources=sources, signals=F.array_join(F.transform(signals, line), "\n"), at=F.lit(at))
