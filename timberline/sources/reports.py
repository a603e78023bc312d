"""Driver-side reports over results that the operators have already reduced. Each returns its text and, if given a path, writes it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from timberline.errors import SpecError, need

# The texts of the reports.
STATS = "Processed {total_lines} lines: {matched_lines} matched ({match_rate:.1%}), {skipped_before} before range, {skipped_after} after range, {unparseable_lines} unparseable."
COUNTS = "Total: {total} | Matched: {matched} | Skipped before: {skipped_before} | Skipped after: {skipped_after} | Unparseable: {unparseable}"
DIFF, NO_DIFF = "+{added} added, -{removed} removed, ={common} common", "No differences found."
SCORE, NO_SCORES = "[score=%.2f] [rules=%s] %s", "No scored entries."
SESSIONS, SESSION = "Sessions found: {}", "  [{index}] entries={entry_count}  start={start}  end={end}  duration={took}"
ALERT, ALERT_LINE = "[{status}] {rule_name}: {matched_count}/{threshold} matches", "  > {}"
NO_MATCHES = "No matches found."
PROFILE = "[{profile}] matched={matched} skipped={skipped} match_rate={rate:.1%}"
RATE = "Total entries : {total}\nBucket size   : {seconds}s\nBuckets       : {buckets}\nPeak window   : {peak}"
SUMMARY = "Total lines   : {total}\nMatched lines : {matched}\nFirst entry   : {first}\nLast entry    : {last}\nSeverity breakdown:"


def plain(value):
    """A value as JSON has it: times in ISO form, rows as objects."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def finished(fmt: str, text, payload, path: str | None, kinds: tuple[str, ...] = ("text", "json")) -> str:
    """The report in the format asked for. text and payload: functions, so that only one is made."""
    need(fmt in kinds, f"unknown report format {fmt!r}; one of {', '.join(kinds)}")
    out = json.dumps(payload(), indent=2) if fmt == "json" else text()
    if path is not None:
        try:
            Path(path).write_text(out + "\n", encoding="utf-8")
        except OSError as e:
            raise SpecError(f"cannot write {path}: {e}") from e
    return out


def stats_report(stats: Row, fmt: str = "text", path: str | None = None) -> str:
    values = stats.asDict()
    return finished(fmt, lambda: STATS.format(**values), lambda: {k: plain(v) for k, v in values.items()} | {"match_rate": round(values["match_rate"], 4)}, path)


def line_count_report(counts: Row, fmt: str = "text", path: str | None = None) -> str:
    return finished(fmt, lambda: COUNTS.format(**counts.asDict()), lambda: plain(counts), path)


def diff_report(diffs: DataFrame, fmt: str = "plain", path: str | None = None) -> str:
    """Of a diff small enough for the driver: summary, removed lines, added lines, each by their text."""
    rows = diffs.orderBy("line").collect()
    parts = {s: [r["line"] for r in rows if r["section"] == s] for s in ("added", "removed", "common")}
    counts = {s: len(v) for s, v in parts.items()}
    changed = bool(parts["added"] or parts["removed"])

    def text() -> str:
        out = ["Summary: " + DIFF.format(**counts)]
        for name, head, sign in (("removed", "--- removed ---", "-"), ("added", "+++ added +++", "+")):
            if parts[name]:
                out += [head, *(f"  {sign} {x}" for x in parts[name])]
        return "\n".join(out if changed else [*out, NO_DIFF])

    return finished(fmt, text, lambda: {"summary": counts | {"has_changes": changed}, **parts}, path, ("plain", "json"))


def diff_summary(diffs: DataFrame) -> str:
    """The counts alone, of a diff of any size."""
    return DIFF.format(**diffs.agg(*[F.count_if(F.col("section") == s).alias(s) for s in ("added", "removed", "common")]).first().asDict())


def pattern_lines(matches: DataFrame) -> DataFrame:
    return matches.select("ord", F.concat(F.when(F.col("group") != "", F.concat(F.lit("["), "group", F.lit("] "))).otherwise(""), F.when(F.col("group") != "", F.col("line")).otherwise(F.regexp_replace("line", r"(?U)^\s+", ""))).alias("value"))


def pattern_report(matches: DataFrame, fmt: str = "plain", path: str | None = None) -> str:
    text = lambda: "\n".join(r["value"] for r in pattern_lines(matches).orderBy("ord").collect()) or NO_MATCHES
    return finished(fmt, text, lambda: [plain(r) for r in matches.orderBy("ord").select("line", "pattern", "group").collect()], path, ("plain", "json"))


def score_lines(scored: DataFrame) -> DataFrame:
    names = F.when(F.size("matched_rules") > 0, F.array_join("matched_rules", ", ")).otherwise("none")
    return scored.select("ord", F.format_string(SCORE, "total_score", names, "line").alias("value"))


def score_report(scored: DataFrame, fmt: str = "text", path: str | None = None) -> str:
    """In the order of the lines."""
    text = lambda: "\n".join(r["value"] for r in score_lines(scored).orderBy("ord").collect()) or NO_SCORES
    return finished(fmt, text, lambda: [plain(r) for r in scored.orderBy("ord").select("line", "total_score", "matched_rules").collect()], path)


def session_report(sessions: DataFrame, fmt: str = "text", path: str | None = None) -> str:
    rows = [plain(r) for r in sessions.orderBy("index").select("index", "entry_count", "start", "end", "duration_seconds").collect()]
    took = lambda r: "unknown" if r["duration_seconds"] is None else f"{r['duration_seconds']:.1f}s"
    text = lambda: "\n".join([SESSIONS.format(len(rows)), *(SESSION.format(took=took(r), **r) for r in rows)])
    return finished(fmt, text, lambda: {"session_count": len(rows), "sessions": rows}, path)


def alert_summary(alert: Row) -> str:
    return ALERT.format(status="TRIGGERED" if alert["triggered"] else "OK", **alert.asDict())


def alert_report(alerts: DataFrame, fmt: str = "plain", path: str | None = None) -> str:
    rows = alerts.collect()

    def text() -> str:
        out = []
        for r in rows:
            out += [alert_summary(r), *(ALERT_LINE.format(x) for x in (r["matching_lines"] if r["triggered"] and "matching_lines" in r else ()))]
        return "\n".join(out)

    return finished(fmt, text, lambda: [plain(r) for r in rows], path, ("plain", "json"))


def profile_report(stats: DataFrame, fmt: str = "text", path: str | None = None) -> str:
    rows = [plain(r) for r in stats.collect()]
    for r in rows:
        r["skipped"] = r["total_lines"] - r["matched_lines"]
        r["match_rate"] = round(r["matched_lines"] / r["total_lines"], 4) if r["total_lines"] else 0.0
    text = lambda: "\n".join(PROFILE.format(profile=r["profile"], matched=r["matched_lines"], skipped=r["skipped"], rate=r["match_rate"]) for r in rows)
    return finished(fmt, text, lambda: rows, path)


def context_block(row: Row) -> str:
    """The matched line marked, its neighbours indented."""
    return "\n".join([*(f"  {x}" for x in row["before"]), f"> {row['matched_line']}", *(f"  {x}" for x in row["after"])])


def group_summary(group: Row) -> str:
    return f"[{group['key']}] {group['count']} entries"


def aggregation_report(groups: DataFrame, totals: Row, fmt: str = "text", path: str | None = None) -> str:
    """groups of aggregate_by_key, as first seen, and the totals of unmatched."""
    rows = groups.orderBy("first_ord").drop("first_ord").collect()
    text = lambda: "\n".join([f"Total lines: {totals['total_lines']}", f"Unmatched: {totals['unmatched_lines']}", *map(group_summary, rows)])
    return finished(fmt, text, lambda: plain(totals) | {"groups": {r["key"]: plain(r) for r in rows}}, path)


def summary_report(totals: Row, severities: DataFrame, top: DataFrame, fmt: str = "text", path: str | None = None) -> str:
    """Of the three results of a summary: totals, counts by severity, most frequent messages."""
    counts = {r["severity"]: r["count"] for r in severities.collect()}
    best = [{"message": r["message"], "count": r["count"]} for r in top.orderBy("place").collect()]
    values = plain(totals)

    def text() -> str:
        head = SUMMARY.format(total=values["total_lines"], matched=values["matched_lines"], first=values["first_timestamp"] or "N/A", last=values["last_timestamp"] or "N/A")
        return "\n".join([head, *(f"  {s:<10}: {n}" for s, n in sorted(counts.items())), "Top messages:", *(f"  [{b['count']:>4}] {b['message']}" for b in best)])

    return finished(fmt, text, lambda: values | {"severity_counts": counts, "top_messages": best}, path)


def rate_report(buckets: DataFrame, bucket_seconds: int, fmt: str = "text", path: str | None = None) -> str:
    order = F.struct("count", -F.unix_micros(F.col("window_start").cast("timestamp")))
    r = buckets.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.max_by(F.struct("window_start", "window_end", "count"), order).alias("peak")).first()
    peak = f"{r['peak']['window_start'].isoformat()} ({r['peak']['count']} entries)" if r["peak"] else "n/a"
    text = lambda: RATE.format(total=r["total"], seconds=bucket_seconds, buckets=r["n"], peak=peak)
    payload = lambda: {"bucket_seconds": bucket_seconds, "total_entries": r["total"], "peak": plain(r["peak"]), "buckets": [plain(b) for b in buckets.orderBy("window_start").collect()]}
    return finished(fmt, text, payload, path)
