"""Secret scans by one combined deterministic automaton.

All rules are parsed into one NFA, made deterministic by subset construction and minimised; its transitions are
an array over byte classes. A batch of texts is one byte stream, cut into lanes of equal length that advance in
step, each byte read once for all rules. Lanes begin in the start state; where the lane before ended elsewhere,
the lane is walked again until both walks agree, so the result is that of one walk over the stream.

While a state accepts a rule, a match of that rule ends there. A rule's last part is one run of bytes of a class (or fixed), so the
places that accept follow each other from the first byte of the run that makes a match to its last; that is the longest match. Where it begins
is found by walking the rule's reversed automaton back from that first byte. No pattern library takes part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pieces

#: Steps between the states that a walk remembers, and lanes that advance together.
REMEMBERED, LANES = 64, 4096


@dataclass(frozen=True)
class Rule:
    """pattern: over bytes, of literals, \\xNN, classes, groups, | ? * + and {n}, {n,}; its last part is fixed or a run of one class that nothing else of it ends in.
    Matches are taken leftmost first, longest, without overlap; then those go in which the run after the fixed beginning
    has less than `run` bytes. `counted`: the automaton itself counts the run (for rules without a rare beginning)."""

    kind: str
    pattern: str
    run: int = 1
    any_case: bool = False
    counted: bool = False


# The three base kinds, then published formats of common credentials.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
RULES = (
    Rule("assign", ASSIGN, 6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 24, counted=True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 10),
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
)
BASE = ("assign", "access", "hex")


class Nfa:
    """Thompson construction for patterns of literals, \\xNN, classes, groups, | ? * + and {n}."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, any_case: bool) -> tuple[int, int]:
        self.text, self.at, self.any_case = pattern, 0, any_case
        start, end = self.choice()
        assert self.at == len(pattern), f"not understood: {pattern[self.at:]}"
        return start, end

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def choice(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.state(), self.state()
        for a, b in parts:
            self.free[start].append(a)
            self.free[b].append(end)
        return start, end

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.free[end].append(a)
            end = b
        return start, end

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        start, end = self.atom()
        sign = self.peek()
        if sign and sign in "?*+":
            self.at += 1
            outer, last = self.state(), self.state()
            self.free[outer].append(start)
            self.free[end].append(last)
            if sign in "?*":
                self.free[outer].append(last)
            if sign in "*+":
                self.free[end].append(start)
            return outer, last
        if sign == "{":
            close = self.text.index("}", self.at)
            least = self.text[self.at + 1 : close].rstrip(",")
            after = close + 1
            for _ in range(int(least) - 1):
                self.at = begin
                a, b = self.atom()
                self.free[end].append(a)
                last, end = a, b
            if self.text[close - 1] == ",":
                self.free[end].append(last if int(least) > 1 else start)
            self.at = after
        return start, end

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.at += 1
            found = self.choice()
            self.at += 1
            return found
        if self.peek() == "[":
            self.at += 1
            allowed: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    allowed |= {*range(low, self.char() + 1)}
                else:
                    allowed.add(low)
            self.at += 1
        else:
            allowed = {self.char()}
        if self.any_case:
            allowed |= {ord(x) for c in allowed for x in (chr(c).lower(), chr(c).upper()) if c < 128}
        start, end = self.state(), self.state()
        self.moves[start].append((frozenset(allowed), end))
        return start, end

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)


@dataclass
class Automaton:
    """class_of: a byte's class; step: next state by state + class (states come multiplied by the number of classes);
    accepts: bit mask of the rules that a state accepts, at the same places; dead: the state that nothing leaves, or -1."""

    class_of: "object"
    step: "object"
    accepts: "object"
    dead: int


def subsets(nfa: Nfa, starts: list[int], final: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction and minimisation. anywhere: a match may begin at each byte. Sets of states are whole numbers."""
    import numpy as np

    def closure(state: int) -> int:
        seen, todo = 1 << state, [state]
        while todo:
            for t in nfa.free[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen

    useful = sum(1 << s for s, moves in enumerate(nfa.moves) if moves) | sum(1 << s for s in final)  # the others only pass on
    distinct = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature: dict[tuple, int] = {}
    class_of = np.array([signature.setdefault(tuple(b in s for s in distinct), len(signature)) for b in range(256)], np.uint8)
    member = {c: b for b, c in reversed(list(enumerate(class_of.tolist())))}
    n = len(signature)
    moves: list[dict[int, int]] = []  # of a state: class -> set
    for state in range(len(nfa.moves)):
        row: dict[int, int] = {}
        for allowed, t in nfa.moves[state]:
            reached = closure(t) & useful
            for c in range(n):
                if member[c] in allowed:
                    row[c] = row.get(c, 0) | reached
        moves.append(row)

    begin = 0
    for s in starts:
        begin |= closure(s) & useful
    again = begin if anywhere else 0
    fresh: dict[int, int] = {}
    for s in range(len(nfa.moves)):
        if again >> s & 1:
            for c, t in moves[s].items():
                fresh[c] = fresh.get(c, 0) | t
    plain = [again | fresh.get(c, 0) for c in range(n)]  # of every set that holds the start
    known, order, table = {begin: 0}, [begin], []
    for here in order:
        row, rest = plain.copy(), here & ~again
        while rest:
            low = rest & -rest
            for c, t in moves[low.bit_length() - 1].items():
                row[c] |= t
            rest ^= low
        for there in row:
            if there not in known:
                known[there] = len(known)
                order.append(there)
        table.append([known[x] for x in row])
    marks = list(final.items())
    accepted = np.array([sum({m for s, m in marks if here >> s & 1}) for here in order], np.int64)

    step = np.array(table)
    block = np.unique(accepted, return_inverse=True)[1].reshape(-1)
    while True:  # states of a block that lead to different blocks part
        new = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    first = np.unique(block, return_index=True)[1]
    names = np.empty(len(first), np.int64)
    names[np.argsort(first)] = np.arange(len(first))  # the start state's block is 0
    block, first = names[block], np.sort(first)
    to, accepts = block[step[first]], accepted[first]
    dead = np.flatnonzero((to == np.arange(len(to))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(class_of, (to * n).astype(np.int32).reshape(-1), np.repeat(accepts, n).astype(np.uint8 if accepts.max() < 256 else np.int64), int(dead[0]) * n if len(dead) else -1)


def combined(rules: tuple[Rule, ...]) -> Automaton:
    nfa, starts, final = Nfa(), [], {}
    for i, rule in enumerate(rules):
        pattern = rule.pattern.removesuffix("+") + f"{{{rule.run},}}" if rule.counted else rule.pattern
        start, end = nfa.add(pattern, rule.any_case)
        starts.append(start)
        final[end] = final.get(end, 0) | 1 << i
    return subsets(nfa, starts, final, True)


def backward(rule: Rule) -> Automaton:
    """Accepts the rule's matches read from their last byte to their first."""
    nfa = Nfa()
    start, end = nfa.add(rule.pattern, rule.any_case)
    turned = Nfa()
    for _ in nfa.moves:
        turned.state()
    for s in range(len(nfa.moves)):
        for allowed, t in nfa.moves[s]:  # a move into t becomes one out of t
            turned.moves[t].append((allowed, s))
        for t in nfa.free[s]:
            turned.free[t].append(s)
    return subsets(turned, [end], {start: 1}, False)


def hits(auto: Automaton, stream):
    """Positions of the stream after whose byte a rule is accepted, in order, and the rules' bit masks."""
    import numpy as np

    lanes = max(1, min(LANES, len(stream) // 512))
    length = -(-len(stream) // lanes)
    padded = np.full(lanes * length, auto.class_of[10], np.uint8)
    padded[: len(stream)] = np.frombuffer(memoryview(stream).tobytes().translate(auto.class_of.tobytes()), np.uint8)
    classes = np.ascontiguousarray(padded.reshape(lanes, length).T)
    del padded
    step, accepts = auto.step, auto.accepts
    now = np.zeros(lanes, np.int32)
    remembered = np.empty((length // REMEMBERED + 1, lanes), np.int32)
    times, where, masks = [], [], []

    def walk(t, now, which):
        at = step[now + (classes[t] if which is None else classes[t, which])]
        found = accepts[at]
        if found.any():
            lane = np.flatnonzero(found)
            times.append(np.full(len(lane), t, np.int64))
            where.append(lane if which is None else which[lane])
            masks.append(found[lane])
        return at

    for t in range(length):
        now = walk(t, now, None)
        if t % REMEMBERED == 0:
            remembered[t // REMEMBERED] = now
    ends, begun = now, np.zeros(lanes, np.int32)
    while True:  # lanes that began in another state than the lane before ended in
        right = np.concatenate([np.zeros(1, np.int32), ends[:-1]])
        wrong = np.flatnonzero(begun != right)
        if not len(wrong):
            break
        begun, now, upto = right, right[wrong], np.zeros(lanes, np.int64)
        old = (times, where, masks)
        times, where, masks = [], [], []
        for t in range(length):
            upto[wrong] = t + 1
            now = walk(t, now, wrong)
            if t % REMEMBERED == 0:
                differ = now != remembered[t // REMEMBERED, wrong]
                remembered[t // REMEMBERED, wrong] = now
                wrong, now = wrong[differ], now[differ]
                if not len(wrong):
                    break
        else:
            ends = ends.copy()
            ends[wrong] = now
        for time, lane, mask in zip(*old):  # what the second walk has passed counts as it found it
            stays = time >= upto[lane]
            times.append(time[stays])
            where.append(lane[stays])
            masks.append(mask[stays])
    if not times:
        return np.empty(0, np.int64), np.empty(0, auto.accepts.dtype)
    at = np.concatenate(where) * length + np.concatenate(times)
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate(masks)[order]


class Scanner:
    """All rules in one automaton; of each rule also its own, for the rest of a run whose beginning belongs to the match before, and the reversed one."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.auto, self.own, self.back = rules, combined(rules), [combined((r,)) for r in rules], [backward(r) for r in rules]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, index of the rule, end) in code points, sorted."""
        import numpy as np

        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        stream = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # no rule contains a line feed
        ends = np.cumsum([len(t) + 1 for t in texts])
        at, masks = hits(self.auto, stream)
        for i, rule in enumerate(self.rules):
            own = at[masks >> i & 1 != 0]
            if not len(own):
                continue
            cuts = np.flatnonzero(np.diff(own) > 1) + 1
            upto = 0
            for first, last in zip(own[np.concatenate([[0], cuts])].tolist(), own[np.append(cuts, len(own)) - 1].tolist()):
                start = self.begin(i, stream, first, upto)
                if start is None:  # it began within the match before; a later one may end in the same run
                    first = self.accepted(i, stream, upto, last)
                    if first is None:
                        continue
                    start = self.begin(i, stream, first, upto)
                upto = last + 1
                if rule.counted or last + 1 - first >= rule.run:
                    doc = int(np.searchsorted(ends, start, "right"))
                    base = int(ends[doc - 1]) if doc else 0
                    out[doc].append((start - base, i, last + 1 - base))
        for doc, spans in enumerate(out):
            if spans:
                out[doc] = sorted(in_code_points(texts[doc], spans))
        return out

    def accepted(self, i: int, stream, at: int, last: int) -> int | None:
        """The first place up to `last` where a match of rule i that begins at `at` or later ends."""
        auto, state = self.own[i], 0
        for place in range(at, last + 1):
            state = int(auto.step[state + int(auto.class_of[stream[place]])])
            if auto.accepts[state]:
                return place
        return None

    def begin(self, i: int, stream, last: int, least: int) -> int | None:
        """The first place, from `least` on, from which rule i matches up to and with the byte at `last`."""
        auto, state, found = self.back[i], 0, None
        for place in range(last, least - 1, -1):
            state = int(auto.step[state + int(auto.class_of[stream[place]])])
            if state == auto.dead:
                break
            if auto.accepts[state]:
                found = place
        return found


def in_code_points(text: bytes, spans):
    if text.isascii():
        return spans
    import numpy as np

    starts = np.frombuffer(text, np.uint8)
    points, at, count = {}, 0, 0
    for place in sorted({p for a, _, b in spans for p in (a, b)}):
        for low in range(at, place, 1 << 20):
            count += int(((starts[low : min(place, low + (1 << 20))] & 0xC0) != 0x80).sum())
        points[place], at = count, place
    return [(points[a], i, points[b]) for a, i, b in spans]


@lru_cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once a process."""
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans array<struct<kind, start, end>> by start, then the rules' order; code points, end exclusive.

    One row per row of docs, repeated ones too, in one pass without a shuffle; whole texts of any length. Null and empty texts have no
    spans, an empty table gives none. Other columns are left out, whatever their names.
    """
    import pyarrow as pa

    kinds = [r.kind for r in rules]
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # compiled on the driver; its size follows from the rules

    def run(batches):
        for batch in pieces(batches):
            found = shared.value.scan([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            spans = pa.array([[{"kind": kinds[i], "start": a, "end": b} for a, i, b in s] for s in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], [id_col, "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark` in text_col (overlapping spans: one mark); other columns as they are, whatever their names.

    One row per row. Null and empty texts stay as they are; texts without secrets keep their bytes.
    """
    import pyarrow as pa

    place, schema = docs.columns.index(text_col), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches):
        for batch in pieces(batches):
            texts = batch.column(place)
            raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            changed = {}
            for row, spans in enumerate(shared.value.scan(raw)):
                if spans:
                    text, parts, upto = raw[row].decode("utf-8", "replace"), [], 0
                    for a, _, b in spans:
                        if a >= upto:
                            parts += [text[upto:a], mark]
                        upto = max(upto, b)
                    changed[row] = "".join([*parts, text[upto:]])
            if changed:
                columns = list(batch.columns)
                columns[place] = pa.array([changed.get(i) if i in changed else t for i, t in enumerate(texts.to_pylist())], texts.type)
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same spans by DuckDB's regular expressions. A match begins where the pieces and matches before it end."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    kinds = []
    for i, rule in enumerate(RULES):
        full = (rule.pattern.replace("password|passwd|secret|token|api_?key", words) if rule.any_case else rule.pattern).replace("'", "''")
        head, run = full[: full.rindex("[")], full[full.rindex("[") :]
        full, grouped = (f"{head}({run})", 2 if rule.kind == "assign" else 1) if run.endswith("+") else (full, 0)
        kinds.append(f"SELECT r, {i} AS k, '{rule.kind}' AS kind, {rule.run} AS least, regexp_extract_all(text, '{full}', 0) AS ms, regexp_extract_all(text, '{full}', {grouped}) AS gs, string_split_regex(text, '{full}') AS ps FROM d WHERE regexp_matches(text, '{full}')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({" UNION ALL ".join(kinds)}
), placed AS (SELECT r, k, kind, least, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM found
), spans AS (
  SELECT r, k, kind, CAST(list_sum([length(x) FOR x IN ps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i-1]]), 0) AS BIGINT) AS a, length(ms[i]) AS n
  FROM placed WHERE length(gs[i]) >= least
), joined AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)
"""


ORACLE = _oracle()
