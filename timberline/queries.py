"""Queries over the driver's tables, one or more for each operator, and the SQL that each is checked against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.regexes import extracted, found
from timberline.functions.text import iso
from timberline.functions.timestamps import strptime_format, timestamp
from timberline.operators import aggregates as agg
from timberline.operators import many, order, rules, slicing
from timberline.plans.stats_table import StatsTable
from timberline.sources import indexed, shared, sinks
from timberline.sources.lines import event_lines, parsed

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
#: Level and event type of a line.
KIND = r"^\S+ \S+ (\S+ \S+)"
#: Where the whole log is cut in two.
MIDDLE = "2024-01-16 00:00:00"

# Rules of the queries.
LEVEL_RULES = [rules.ClassifierRule("errors", "failure", r"\bERROR\b", 1.0), rules.ClassifierRule("warnings", "caution", r"\bWARN\b", 0.9), rules.ClassifierRule("money", "sales", r"purchase user=\d+", 0.5)]
SCORES = [rules.ScoringRule("error", "ERROR", 10), rules.ScoringRule("warn", "WARN", 5), rules.ScoringRule("one", r"user=1\d*\b", 2.5), rules.ScoringRule("click", "click", -1)]
TAGS = [rules.TagRule("err", "error"), rules.TagRule("buyer", r"purchase|signup"), rules.TagRule("low", r"user=\d\b")]
WORDS = {"problem": ["error", "fatal"], "shop": ["purchase", "signup"], "seven": ["user=7"]}
ROUTES = [rules.RouteRule("e", "ERROR", "errors"), rules.RouteRule("w", "WARN", "warnings"), rules.RouteRule("p", "PURCHASE", "sales", True)]
PATTERNS = [rules.PatternRule("ERROR", "bad"), rules.PatternRule("purchase", "sale", False), rules.PatternRule(r"user=\d\b", "early")]
FIELDS = [rules.FieldRule("user", r"user=(?P<value>\d+)"), rules.FieldRule("k", r'"k": (\d+)'), rules.FieldRule("bad", r"ERROR")]
KEYWORDS = [rules.KeywordRule("Error", "[", "]"), rules.KeywordRule("user", "**", "**")]
THRESHOLDS = [agg.ThresholdRule("errors", "ERROR", 100), agg.ThresholdRule("user 7", "user=7 ", 1_000_000), agg.ThresholdRule("none", "nothing like it", 1)]


@dataclass(frozen=True)
class Range:
    name: str
    start: str | None
    end: str | None


PROFILES = [Range("first", "2024-01-01 00:00:00", "2024-01-03 00:00:00"), Range("late", "2024-01-20 00:00:00", None), Range("never", "2030-01-01 00:00:00", "2031-01-01 00:00:00"), Range("first", "2024-01-02 00:00:00", "2024-01-09 00:00:00")]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(event_lines(spark, sf_dir))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and conversations: lines with and without timestamps."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.lit(10_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.lit("conversations").alias("source"), F.col("text").alias("line"))
    return parsed(event_lines(spark, sf_dir).unionByName(talk))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO order="), F.col("o_orderkey").cast("string"), F.lit(" status="), "o_orderstatus")
    return parsed(orders.select(F.col("o_orderkey").alias("ord"), F.lit("orders").alias("source"), line.alias("line")))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff of the whole log before and from MIDDLE, by whole messages."""
    lines, early = timed(spark, sf_dir), F.col("timestamp") < F.lit(MIDDLE).cast("timestamp_ntz")
    message = F.expr("substring(line, 21)").alias("line")
    return agg.diff(lines.where(early).select(message), lines.where(~early).select(message))


def joined(c: str):
    return F.array_join(c, "|").alias(c)


def hourly_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = slicing.slice_lines(timed(spark, sf_dir), START, END).withColumn("severity", rules.severity(F.col("line")))
    return kept.groupBy(F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz").alias("hour"), "severity").agg(F.count("*").alias("n"))


def stats_columns(df: DataFrame) -> DataFrame:
    return df.select("total_lines", "matched_lines", "skipped_before", "skipped_after", "unparseable_lines", "first_matched_ts", "last_matched_ts", "match_rate")


def fields(s, d):
    f = rules.extract_fields(log(s, d), FIELDS)
    return f.select("ord", F.col("fields")["user"].alias("user"), F.col("fields")["k"].alias("k"), F.col("fields")["bad"].alias("bad"))


# Patterns in Python's dialect; what Java or RE2 would read otherwise, or not at all.
DIALECT = {
    "again": r"user=\d*(\d)\1", "either": r"(ERROR )?(?(1)error|view) ", "brackets": r"[[{]|[a&&b]&", "few": r"user=\d{,2} ", "ends": r"[}.]$", "ahead": r"(?<=user=)\d+(?= props)",
    "local": r"(?i:PURCHASE) (?-i:user)", "named": r"(?P<first>[a-z])(?P=first)", "never": r"(?>user=\d+)\d", "word": r"\b[^\W\d_]+\b",
}
SECOND_DIGIT = r"user=(\d)(\d)?(\d)?"


def dialect(s, d):
    line = F.col("line")
    return mixed(s, d).select("ord", *[found(line, p).alias(n) for n, p in DIALECT.items()], *[extracted(line, SECOND_DIGIT, i).alias(f"digit{i}") for i in (1, 2, 3)], extracted(line, DIALECT["ahead"], 0).alias("user"))


# Strptime layouts of the lines below.
LAYOUTS = ("%A, %d %B %Y %I:%M %p", "UTC %y%m%d %H:%M:%S.%f", "%j of %Y")


def custom_formats(s, d):
    """Documents as lines of an index in three layouts, by turns, and the time that is read from each."""
    docs, key = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), F.col("doc_id")
    at = F.timestamp_add("SECOND", (key * 7919 % 900_000_000).cast("int"), F.lit("1992-01-01").cast("timestamp_ntz"))
    text = F.when(key % 3 == 0, F.date_format(at, "EEEE, d MMMM yyyy hh:mm a")).when(key % 3 == 1, F.concat(F.lit("UTC "), F.date_format(at, "yyMMdd H:m:s"), F.lit("."), F.lpad((key % 1000).cast("string"), 3, "0"))).otherwise(F.date_format(at, "D 'of' yyyy"))
    lines = docs.select(key.alias("ord"), F.concat(F.lit("<"), text, F.lit("> document="), key.cast("string"), F.lit(" source="), F.coalesce("source", F.lit("-"))).alias("line"))
    return lines.select("ord", timestamp(F.col("line"), tuple(strptime_format(f) for f in LAYOUTS)).alias("timestamp"))


def slice_by_index(s, d):
    """Events and conversations as text files, sorted by time, and a range of them by probes. What has no time stands first; line ends inside of a text become blanks."""
    path = shared.new_folder(s, "logs")
    mixed(s, d).orderBy("timestamp", "ord").select(F.translate("line", "\r\n", "  ").alias("line")).write.text(path)
    return indexed.slice_files(s, path, START, END).select("timestamp", "line")


def file_stats(s, d):
    """Stats of text files in two steps: half of the lines, then the others beside them; only these are read then, and the counts merged."""
    path, table = shared.new_folder(s, "logs"), StatsTable(s, shared.new_folder(s, "stats"))
    for half in (0, 1):
        mixed(s, d).where(F.col("ord") % 2 == half).select(F.translate("line", "\r\n", "  ").alias("line")).write.mode("append").text(path)
        row = table.stats(path, START, END)
    kinds = ", ".join(f"{c} {'double' if c == 'match_rate' else 'timestamp_ntz' if c.endswith('_ts') else 'long'}" for c in row.__fields__)
    return s.createDataFrame([tuple(row)], kinds)


def profile_join(s, d):
    """A profile for each customer."""
    key = F.col("c_custkey")
    start = F.timestamp_add("SECOND", (key * 7919 % 2_600_000).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    end = F.timestamp_add("SECOND", (key % 997 * 61).cast("int"), start)
    customers = s.read.parquet(f"{d}/customer.parquet").select(key.cast("string").alias("profile"), F.when(key % 50 != 0, start).alias("start"), F.when(key % 49 != 0, end).alias("end"))
    return many.profile_join(mixed(s, d), customers)


#: Each user, and each user's errors.
MANY_RULES = [agg.ThresholdRule(f"user {i}", f"user={i} ", i % 40 + 1) for i in range(2500)] + [agg.ThresholdRule(f"errors of {i}", f"ERROR error user={i} ", i % 7 + 1) for i in range(2500)]


CHAIN = [rules.FormatterStep("strip", lambda c: F.trim(c)), rules.FormatterStep("upper", lambda c: F.upper(c)), rules.FormatterStep("no_debug", lambda c: F.when(~c.contains("DEBUG"), c))]

QUERIES = {
    "q_hourly_severity": hourly_severity,
    "q_slice_range": lambda s, d: slicing.slice_lines(timed(s, d), START, END).select("ord", "timestamp", "line"),
    "q_slice_open_end": lambda s, d: slicing.slice_lines(timed(s, d), end=START).select("ord", "timestamp", "line"),
    "q_slice_include_unparsed": lambda s, d: slicing.slice_lines(mixed(s, d), START, END, True).select("ord", "timestamp", "line"),
    "q_line_count": lambda s, d: slicing.line_count(mixed(s, d), START, END),
    "q_slice_stats": lambda s, d: stats_columns(slicing.slice_stats(mixed(s, d), START, END)),
    "q_severity_extract": lambda s, d: mixed(s, d).select("ord", rules.severity(F.col("line")).alias("severity")),
    "q_severity_filter": lambda s, d: rules.severity_filter(log(s, d), ["warn", "ERROR"]).select("ord", "severity"),
    "q_pattern_match": lambda s, d: rules.pattern_match(log(s, d), PATTERNS).select("ord", "pattern", "group"),
    "q_classify": lambda s, d: rules.classify(log(s, d), LEVEL_RULES).select("ord", "category", "confidence", "matched_rule"),
    "q_category_counts": lambda s, d: agg.category_counts(rules.classify(log(s, d), LEVEL_RULES)),
    "q_route": lambda s, d: rules.route(log(s, d), ROUTES).groupBy("destination", "rule_name").agg(F.count("*").alias("n")),
    "q_tag": lambda s, d: rules.tag(log(s, d), TAGS, [r"\d{4}-\d{2}-\d{2}"]).select("ord", joined("tags"), "timestamp"),
    "q_annotate": lambda s, d: rules.annotate(log(s, d), WORDS).select("ord", joined("tags"), "source"),
    "q_score": lambda s, d: rules.score(log(s, d), SCORES).select("ord", "total_score", joined("matched_rules")),
    "q_score_threshold": lambda s, d: rules.score(log(s, d), SCORES, 7.5).select("ord", "total_score"),
    "q_field_extract": fields,
    "q_highlight": lambda s, d: rules.highlight(log(s, d), KEYWORDS).select("ord", joined("matched_keywords"), "highlighted"),
    "q_format_chain": lambda s, d: rules.format_chain(log(s, d), CHAIN).select("ord", "transformed", joined("stages")),
    "q_aggregate_by_key": lambda s, d: agg.aggregate_by_key(log(s, d), r"user=(\d+)"),
    "q_rate_60s": lambda s, d: agg.rate(timed(s, d), 60),
    "q_rate_45s": lambda s, d: agg.rate(timed(s, d), 45),
    "q_rate_tumbling_90s": lambda s, d: agg.rate(timed(s, d), 90, "tumbling"),
    "q_rate_peak": lambda s, d: agg.peak(agg.rate(timed(s, d), 60)),
    "q_summary_totals": lambda s, d: agg.summary_totals(mixed(s, d)),
    "q_summary_severity": lambda s, d: agg.summary_severities(mixed(s, d)),
    "q_summary_top": lambda s, d: agg.summary_top(timed(s, d), 10),
    "q_threshold_alert": lambda s, d: agg.alerts(log(s, d), THRESHOLDS),
    "q_context": lambda s, d: order.context(log(s, d), F.col("line").contains("ERROR"), 2, 1).select("line_number", "matched_line", joined("before"), joined("after")),
    "q_dedup": lambda s, d: order.dedup(timed(s, d), 300, F.regexp_extract("line", KIND, 1)).select("key", "raw", "count", "first_seen", "last_seen", "first_ord"),
    "q_dedup_message": lambda s, d: order.dedup(timed(s, d), 86_400).select("key", "raw", "count", "first_seen", "last_seen", "first_ord"),
    "q_sessions_global": lambda s, d: order.sessions(timed(s, d), 600),
    "q_sessions_by_user": lambda s, d: order.sessions(timed(s, d).withColumn("user", F.regexp_extract("line", r"user=(\d+)", 1)), 6 * 3600, ["user"]),
    "q_sample": lambda s, d: order.sample(slicing.slice_lines(timed(s, d), START, END), 97).select("ord", "idx", "step", "is_exact"),
    "q_merge": lambda s, d: agg.merge(timed(s, d), order_lines(s, d)),
    "q_diff_added": lambda s, d: halves(s, d).where("section = 'added'").select("line"),
    "q_diff_removed": lambda s, d: halves(s, d).where("section = 'removed'").select("line"),
    "q_diff_common": lambda s, d: halves(s, d).where("section = 'common'").select("line"),
    "q_multi_profile": lambda s, d: agg.profile_stats(s, mixed(s, d), PROFILES),
    "q_format_json": lambda s, d: sinks.json_lines(timed(s, d)).withColumn("timestamp", F.get_json_object("value", "$.timestamp")).select("timestamp", F.get_json_object("value", "$.line").alias("line")),
    "q_format_csv": lambda s, d: sinks.csv_lines(timed(s, d)).select("value"),
    "q_regex_dialect": dialect,
    "q_custom_formats": custom_formats,
    "q_slice_by_index": slice_by_index,
    "q_file_stats": file_stats,
    "q_profile_join": profile_join,
    "q_many_literals": lambda s, d: many.alerts_many(mixed(s, d), MANY_RULES),
}

EVENTS = """WITH ev AS (SELECT event_id AS ord, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END
 || ' ' || event_type || ' user=' || user_id || ' props=' || props AS line, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t, user_id FROM events)"""
MIXED = EVENTS + """, mixed AS (SELECT ord, line, t FROM ev UNION ALL
 SELECT 10000000000 + conv_id * 1000 + turn, text, CAST(try_strptime(replace(nullif(regexp_extract(text, '(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2})', 1), ''), 'T', ' '), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) FROM conversations)"""
SEVERITY = r"""CASE upper(nullif(regexp_extract(line, '(?i)\b(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b', 1), '')) WHEN 'WARN' THEN 'WARNING' WHEN 'FATAL' THEN 'CRITICAL' ELSE upper(nullif(regexp_extract(line, '(?i)\b(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b', 1), '')) END"""
INSIDE = f"t BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
CLASSES = [("failure", "1.0", "errors", r"regexp_matches(line, '\bERROR\b')"), ("caution", "0.9", "warnings", r"regexp_matches(line, '\bWARN\b')"), ("sales", "0.5", "money", r"regexp_matches(line, 'purchase user=\d+')")]


def _case(i: int, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c[3]} THEN " + (c[i] if i == 1 else f"'{c[i]}'") for c in CLASSES) + f" ELSE {other} END"


def _tags(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in pairs) + "], lambda x: x IS NOT NULL), '|')"


_score = r"(CASE WHEN contains(line, 'ERROR') THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN contains(line, 'WARN') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(line, 'user=1\d*\b') THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN contains(line, 'click') THEN -1 ELSE 0 END)"
_stats = f"""count(*) AS total_lines, count(*) FILTER (WHERE {INSIDE}) AS matched_lines, count(*) FILTER (WHERE t < TIMESTAMP '{START}') AS skipped_before, count(*) FILTER (WHERE t > TIMESTAMP '{END}') AS skipped_after, count(*) FILTER (WHERE t IS NULL) AS unparseable_lines"""


def _rate(n: int) -> str:
    return f"{EVENTS}, b AS (SELECT date_trunc('minute', t) + to_seconds(CAST(floor(second(t) / {n}) * {n} AS BIGINT)) AS window_start FROM ev) SELECT window_start, window_start + INTERVAL {n} SECOND AS window_end, count(*) AS count FROM b GROUP BY 1"


def _halves(op: str, a: str, b: str) -> str:
    return f"{EVENTS} SELECT trim(substr(line, 21)) AS line FROM ev WHERE t {a} TIMESTAMP '{MIDDLE}' {op} SELECT trim(substr(line, 21)) FROM ev WHERE t {b} TIMESTAMP '{MIDDLE}'"


def _dedup(key: str, seconds: int) -> str:
    return f"{EVENTS}, k AS (SELECT *, {key} AS key FROM ev), f AS (SELECT *, CASE WHEN epoch(t) - epoch(lag(t) OVER (PARTITION BY key ORDER BY ord)) <= {seconds} THEN 0 ELSE 1 END AS n FROM k), g AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ord) AS run FROM f) SELECT key, arg_min(line, ord) AS raw, count(*) AS count, arg_min(t, ord) AS first_seen, arg_max(t, ord) AS last_seen, min(ord) AS first_ord FROM g GROUP BY key, run"


def _sessions(gap: int, by: str) -> str:
    over = f"OVER ({'PARTITION BY ' + by if by else ''} ORDER BY ord)"
    key = f"{by} AS user, " if by else ""
    return f"""{EVENTS}, f AS (SELECT *, CASE WHEN epoch(t) - epoch(lag(t) {over}) > {gap} THEN 1 ELSE 0 END AS n FROM ev), g AS (SELECT *, CAST(sum(n) {over} AS BIGINT) AS index FROM f)
 SELECT {key}index, count(*) AS entry_count, arg_min(t, ord) AS start, arg_max(t, ord) AS "end", CAST(epoch(arg_max(t, ord)) - epoch(arg_min(t, ord)) AS DOUBLE) AS duration_seconds FROM g GROUP BY {by + ', ' if by else ''}index"""


_profile = " UNION ALL ".join(
    f"SELECT '{n}' AS profile, count(*) AS total_lines, count(*) FILTER (WHERE {w}) AS matched_lines, count(*) FILTER (WHERE t IS NULL) AS unparseable_lines, min(t) FILTER (WHERE {w}) AS first_matched_ts, max(t) FILTER (WHERE {w}) AS last_matched_ts FROM mixed"
    for n, w in (("first", "t BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'"), ("late", "t >= TIMESTAMP '2024-01-20 00:00:00'"), ("never", "t BETWEEN TIMESTAMP '2030-01-01 00:00:00' AND TIMESTAMP '2031-01-01 00:00:00'"))
)

ORACLES: dict[str, str] = {
    "q_hourly_severity": f"{EVENTS} SELECT date_trunc('hour', t) AS hour, {SEVERITY} AS severity, count(*) AS n FROM ev WHERE {INSIDE} GROUP BY ALL",
    "q_slice_range": f"{EVENTS} SELECT ord, t AS timestamp, line FROM ev WHERE {INSIDE}",
    "q_slice_open_end": f"{EVENTS} SELECT ord, t AS timestamp, line FROM ev WHERE t <= TIMESTAMP '{START}'",
    "q_slice_include_unparsed": f"{MIXED} SELECT ord, t AS timestamp, line FROM mixed WHERE t IS NULL OR {INSIDE}",
    "q_line_count": f"{MIXED} SELECT total_lines AS total, matched_lines AS matched, skipped_before, skipped_after, unparseable_lines AS unparseable, total_lines - matched_lines AS skipped FROM (SELECT {_stats} FROM mixed)",
    "q_slice_stats": f"{MIXED} SELECT *, matched_lines / total_lines AS match_rate FROM (SELECT {_stats}, min(t) FILTER (WHERE {INSIDE}) AS first_matched_ts, max(t) FILTER (WHERE {INSIDE}) AS last_matched_ts FROM mixed)",
    "q_severity_extract": f"{MIXED} SELECT ord, {SEVERITY} AS severity FROM mixed",
    "q_severity_filter": f"{EVENTS} SELECT ord, {SEVERITY} AS severity FROM ev WHERE {SEVERITY} IN ('WARNING', 'ERROR')",
    "q_pattern_match": EVENTS + r""" SELECT ord, pattern, "group" FROM (SELECT ord, CASE WHEN contains(line, 'ERROR') THEN 'ERROR' WHEN contains(line, 'purchase') THEN 'purchase' WHEN regexp_matches(line, 'user=\d\b') THEN 'user=\d\b' END AS pattern, CASE WHEN contains(line, 'ERROR') THEN 'bad' WHEN contains(line, 'purchase') THEN 'sale' ELSE 'early' END AS "group" FROM ev) WHERE pattern IS NOT NULL""",
    "q_classify": f"{EVENTS} SELECT ord, {_case(0, 'NULL')} AS category, CAST({_case(1, '0.0')} AS DOUBLE) AS confidence, {_case(2, 'NULL')} AS matched_rule FROM ev",
    "q_category_counts": f"{EVENTS} SELECT {_case(0, chr(39) + '__unclassified__' + chr(39))} AS category, count(*) AS count FROM ev GROUP BY 1",
    "q_route": EVENTS + " SELECT CASE WHEN contains(line, 'ERROR') THEN 'errors' WHEN contains(line, 'WARN') THEN 'warnings' WHEN contains(upper(line), 'PURCHASE') THEN 'sales' ELSE 'unmatched' END AS destination, CASE WHEN contains(line, 'ERROR') THEN 'e' WHEN contains(line, 'WARN') THEN 'w' WHEN contains(upper(line), 'PURCHASE') THEN 'p' END AS rule_name, count(*) AS n FROM ev GROUP BY ALL",
    "q_tag": EVENTS + " SELECT ord, " + _tags(("err", "contains(lower(line), 'error')"), ("buyer", "regexp_matches(line, 'purchase|signup')"), ("low", r"regexp_matches(line, 'user=\d\b')")) + " AS tags, substr(line, 1, 10) AS timestamp FROM ev",
    "q_annotate": EVENTS + " SELECT ord, " + _tags(("problem", "contains(lower(line), 'error') OR contains(lower(line), 'fatal')"), ("shop", "contains(line, 'purchase') OR contains(line, 'signup')"), ("seven", "contains(line, 'user=7')")) + " AS tags, 'events' AS source FROM ev",
    "q_score": f"{EVENTS} SELECT ord, {_score} AS total_score, " + _tags(("error", "contains(line, 'ERROR')"), ("warn", "contains(line, 'WARN')"), ("one", r"regexp_matches(line, 'user=1\d*\b')"), ("click", "contains(line, 'click')")) + " AS matched_rules FROM ev",
    "q_score_threshold": f"{EVENTS} SELECT ord, {_score} AS total_score FROM ev WHERE {_score} >= 7.5",
    "q_field_extract": EVENTS + r""" SELECT ord, nullif(regexp_extract(line, 'user=(\d+)', 1), '') AS "user", nullif(regexp_extract(line, '"k": (\d+)', 1), '') AS k, nullif(regexp_extract(line, 'ERROR'), '') AS bad FROM ev""",
    "q_highlight": EVENTS + r""" SELECT ord, CASE WHEN contains(lower(line), 'error') THEN 'Error|user' ELSE 'user' END AS matched_keywords, regexp_replace(regexp_replace(line, '(?i)(error)', '[\1]', 'g'), '(?i)(user)', '**\1**', 'g') AS highlighted FROM ev""",
    "q_format_chain": EVENTS + " SELECT ord, upper(line) AS transformed, 'strip|upper|no_debug' AS stages FROM ev WHERE NOT contains(line, 'DEBUG')",
    "q_aggregate_by_key": EVENTS + r" SELECT regexp_extract(line, 'user=(\d+)', 1) AS key, count(*) AS count, arg_min(line, ord) AS first_line, arg_max(line, ord) AS last_line, min(ord) AS first_ord FROM ev GROUP BY 1",
    "q_rate_60s": _rate(60),
    "q_rate_45s": _rate(45),
    "q_rate_tumbling_90s": f"{EVENTS} SELECT make_timestamp(CAST(floor(epoch(t) / 90) * 90 AS BIGINT) * 1000000) AS window_start, make_timestamp(CAST(floor(epoch(t) / 90) * 90 + 90 AS BIGINT) * 1000000) AS window_end, count(*) AS count FROM ev GROUP BY ALL",
    "q_rate_peak": f"SELECT * FROM ({_rate(60)}) ORDER BY count DESC, window_start LIMIT 1",
    "q_summary_totals": f"{MIXED} SELECT count(*) AS total_lines, count(t) AS matched_lines, arg_min(t, ord) AS first_timestamp, arg_max(t, ord) AS last_timestamp FROM mixed",
    "q_summary_severity": f"{MIXED} SELECT severity, count(*) AS count FROM (SELECT CASE " + " ".join(f"WHEN contains(upper(line), '{x}') THEN '{x}'" for x in agg.SUMMARY_LEVELS) + " END AS severity FROM mixed) WHERE severity IS NOT NULL GROUP BY 1",
    "q_summary_top": f"{EVENTS}, c AS (SELECT substr(trim(substr(line, 21)), 1, 80) AS message, count(*) AS count, min(ord) AS first_ord FROM ev GROUP BY 1) SELECT message, count, first_ord, CAST(row_number() OVER (ORDER BY count DESC, first_ord) AS INT) AS place FROM c ORDER BY count DESC, first_ord LIMIT 10",
    "q_threshold_alert": f"{EVENTS}, r(rule_name, pattern, threshold) AS (VALUES ('errors', 'ERROR', 100::BIGINT), ('user 7', 'user=7 ', 1000000::BIGINT), ('none', 'nothing like it', 1::BIGINT)) SELECT rule_name, threshold, count(line) AS matched_count, count(line) >= threshold AS triggered FROM r LEFT JOIN ev ON contains(line, pattern) GROUP BY rule_name, threshold",
    "q_context": f"{EVENTS}, w AS (SELECT row_number() OVER (ORDER BY ord) AS line_number, line, lag(line, 2) OVER (ORDER BY ord) AS b2, lag(line) OVER (ORDER BY ord) AS b1, lead(line) OVER (ORDER BY ord) AS a1 FROM ev) SELECT line_number, line AS matched_line, concat_ws('|', b2, b1) AS before, coalesce(a1, '') AS after FROM w WHERE contains(line, 'ERROR')",
    "q_dedup": _dedup(f"regexp_extract(line, '{KIND}', 1)", 300),
    "q_dedup_message": _dedup("trim(substr(line, 20))", 86_400),
    "q_sessions_global": _sessions(600, ""),
    "q_sessions_by_user": _sessions(21600, "CAST(user_id AS VARCHAR)"),
    "q_sample": f"{EVENTS}, p AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS pos, count(*) OVER () AS total FROM ev WHERE {INSIDE}) SELECT ord, pos // step AS idx, step, total <= CAST(ceil(total / step) AS BIGINT) AS is_exact FROM (SELECT *, CAST(greatest(1, ceil(total / 97)) AS BIGINT) AS step FROM p) WHERE pos % step = 0",
    "q_merge": f"{EVENTS} SELECT 0 AS file_idx, ord, 'events' AS source, t AS timestamp, line FROM ev UNION ALL SELECT 1, o_orderkey, 'orders', CAST(date_trunc('second', o_orderdate) AS TIMESTAMP), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' INFO order=' || o_orderkey || ' status=' || o_orderstatus FROM orders",
    "q_diff_added": _halves("EXCEPT", ">=", "<"),
    "q_diff_removed": _halves("EXCEPT", "<", ">="),
    "q_diff_common": _halves("INTERSECT", "<", ">="),
    "q_multi_profile": f"{MIXED} {_profile}",
    "q_format_json": f"{EVENTS} SELECT strftime(t, '%Y-%m-%dT%H:%M:%S') AS timestamp, line FROM ev",
    "q_format_csv": f"""{EVENTS} SELECT strftime(t, '%Y-%m-%dT%H:%M:%S') || ',' || '"' || replace(line, '"', '""') || '"' AS value FROM ev""",
    "q_regex_dialect": MIXED + r""" SELECT ord, regexp_matches(line, 'user=\d*(00|11|22|33|44|55|66|77|88|99)') AS again, contains(line, 'ERROR error ') OR contains(line, 'view ')  AS either,
 regexp_matches(line, '[\[{]|[ab&]&') AS brackets, regexp_matches(line, 'user=\d{0,2} ') AS few, regexp_matches(line, '[}.]\n?\z') AS ends, regexp_matches(line, 'user=\d+ props') AS ahead, regexp_matches(line, '(?i:PURCHASE) user') AS "local",
 regexp_matches(line, 'aa|bb|cc|dd|ee|ff|gg|hh|ii|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz') AS named, false AS never, regexp_matches(line, '(^|[^\pL\pN_])\pL+([^\pL\pN_]|$)') AS word,
 nullif(regexp_extract(line, 'user=(\d)(\d)?(\d)?', 1), '') AS digit1, nullif(regexp_extract(line, 'user=(\d)(\d)?(\d)?', 2), '') AS digit2, nullif(regexp_extract(line, 'user=(\d)(\d)?(\d)?', 3), '') AS digit3, nullif(regexp_extract(line, 'user=(\d+) props', 1), '') AS "user" FROM mixed""",
    "q_custom_formats": """SELECT doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN date_trunc('minute', t) WHEN 1 THEN t + to_milliseconds(doc_id % 1000) ELSE date_trunc('day', t) END AS timestamp
 FROM (SELECT doc_id, TIMESTAMP '1992-01-01' + to_seconds(doc_id * 7919 % 900000000) AS t FROM documents)""",
    "q_slice_by_index": f"{MIXED} SELECT t AS timestamp, replace(replace(line, chr(13), ' '), chr(10), ' ') AS line FROM mixed WHERE {INSIDE}",
    "q_file_stats": f"{MIXED} SELECT *, matched_lines / total_lines AS match_rate FROM (SELECT {_stats}, min(t) FILTER (WHERE {INSIDE}) AS first_matched_ts, max(t) FILTER (WHERE {INSIDE}) AS last_matched_ts FROM mixed)",
    "q_profile_join": MIXED + """, p AS (SELECT c_custkey AS k, TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 7919 % 2600000) AS a FROM customer), q AS (SELECT k, CASE WHEN k % 50 <> 0 THEN a END AS a, CASE WHEN k % 49 <> 0 THEN a + to_seconds(k % 997 * 61) END AS b FROM p)
 SELECT CAST(k AS VARCHAR) AS profile, (SELECT count(*) FROM mixed) AS total_lines, count(t) AS matched_lines, (SELECT count(*) FROM mixed WHERE t IS NULL) AS unparseable_lines, min(t) AS first_matched_ts, max(t) AS last_matched_ts
 FROM q LEFT JOIN mixed ON (a IS NULL OR t >= a) AND (b IS NULL OR t <= b) AND t IS NOT NULL GROUP BY k""",
    "q_many_literals": MIXED + """, r AS (SELECT 'user ' || i AS rule_name, 'user=' || i || ' ' AS pattern, i % 40 + 1 AS threshold FROM range(2500) x(i) UNION ALL SELECT 'errors of ' || i, 'ERROR error user=' || i || ' ', i % 7 + 1 FROM range(2500) x(i))
 SELECT rule_name, threshold, count(line) AS matched_count, count(line) >= threshold AS triggered FROM r LEFT JOIN mixed ON contains(line, pattern) GROUP BY rule_name, threshold""",
}
