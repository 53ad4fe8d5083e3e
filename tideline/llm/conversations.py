"""Conversation repair: a grammar-compressed shortest path over edits.

A conversation's rows, in order of turn, are symbols: role class (system, user, assistant, other)
and fault (none, truncated, to be deleted). Edits keep, rerole or delete a row or insert an empty user or
assistant row, so that the roles become ``(s?(ua)+)?``; the cheapest edits win, ties go to the
audit (the edits' initials in order) that is least in ASCII. Each symbol is a min-plus matrix over the four
states of that pattern, with costs and audits.

Different symbol sequences are collected once for all conversations, and a Re-Pair grammar over them is
built in rounds: Spark counts adjacent pairs, the commonest ``ROUND_RULES`` become rules. Each rule has one
matrix, the product of its two parts' matrices, whose audits are ropes (shared halves with hashes, so
that ties are settled without spelling them out); rules are evaluated bottom-up once and sent to all tasks, at
most ``ROUNDS`` x ``ROUND_RULES`` of them. The matrix of a sequence is the product of what its rewritten
form holds. Audits of equal cost never are prefixes of one another (an audit's letters fix its
cost), so that the lesser of two halves stays the lesser in any product.

A conversation of any size is cut into chunks of ``CHUNK`` rows: rows are range-partitioned by
conversation and turn, each chunk is a matrix, and chunks are folded in order. Duplicates are found by
the smallest place of each role and text of a conversation. Texts are shuffled once, for the repaired
conversations; these stream through, one row at a time, and only audits (a letter for each edit) are held whole.

Results: see ``audited``, ``repaired`` and ``repair_report``. A null role or text counts as one
space; a text is blank if it has nothing but the six characters of ``SPACE``. Rows of null turn
come first; rows of one turn go by role, then by the text's SHA-256, so that repeated rows are
adjacent (and duplicates). Rows without conv_id are one conversation. An empty table gives an empty
result. Texts of any length are read whole. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import removed, stored

SPACE = " \t\n\x0b\f\r"
CHUNK = 4096  # rows that are one matrix at most
ROUNDS, ROUND_RULES, LEAST = 6, 64, 2  # of the grammar; how often a pair occurs at least
RULE = 0xE000  # the character of the first rule
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
STATES = range(4)  # before anything, after system, after user, after assistant
ENDS = (0, 3)
LONG = (1 << 63) - 1
PRIME, BASE = (1 << 61) - 1, 1_000_003
PIECE = "start long, seq string, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# --- ropes and matrices ---------------------------------------------------------------------


class Rope:
    """A text as a leaf or as two ropes, with its size and a hash."""

    __slots__ = ("hash", "left", "right", "size", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * BASE + ord(c)) % PRIME
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(BASE, right.size, PRIME) + right.hash) % PRIME

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(None, self, other)

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if x.text is None:
                open_ += [x.right, x.left]
            else:
                out.append(x.text)
        return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """Whether a comes before b; equal stretches of equal size are passed over by their hashes."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if isinstance(x, Rope) and isinstance(y, Rope) and x.size == y.size and x.hash == y.hash:
            continue
        if isinstance(x, Rope) and x.text is None and (not isinstance(y, Rope) or y.text is not None or x.size >= y.size):
            left += [x.right, x.left]
            right.append(y)
        elif isinstance(y, Rope) and y.text is None:
            right += [y.right, y.left]
            left.append(x)
        else:
            s, t = (z.text if isinstance(z, Rope) else z for z in (x, y))
            n = min(len(s), len(t))
            if s[:n] != t[:n]:
                return s[:n] < t[:n]
            left += [s[n:]] if len(s) > n else []
            right += [t[n:]] if len(t) > n else []
    return bool(right)


Entry = tuple[int, Rope] | None
EMPTY = Rope("")
#: Which state a user or assistant row that follows the state must have: its role and the next state.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    return a if a[0] < b[0] or a[0] == b[0] and not less(b[1], a[1]) else b


def times(a: list[list[Entry]], b: list[list[Entry]]) -> list[list[Entry]]:
    """The min-plus product: cheapest way over any state between."""
    out = []
    for row in a:
        of: list[Entry] = [None] * 4
        for q, x in enumerate(row):
            if x is not None:
                for r, y in enumerate(b[q]):
                    if y is not None and (of[r] is None or x[0] + y[0] <= of[r][0]):
                        of[r] = better(of[r], (x[0] + y[0], x[1] + y[1]))
        out.append(of)
    return out


def _inserts() -> list[list[Entry]]:
    """The fewest inserts from state to state."""
    out: list[list[Entry]] = [[(0, EMPTY) if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        q = p
        for n in (1, 2):
            q = NEXT[q][1]
            if out[p][q] is None:
                out[p][q] = (n * INSERT, Rope("I" * n))
    return out


INSERTS = _inserts()


def symbol(s: str) -> list[list[Entry]]:
    """The matrix of a row after any inserts: s, u, a or o, as a capital if truncated; x must go."""
    edit: list[list[Entry]] = [[None] * 4 for _ in STATES]
    more = TRUNCATED * s.isupper()
    for p in STATES:
        edit[p][p] = (DELETE, Rope("D"))
        if s != "x":
            to = NEXT[p][1]
            edit[p][to] = better(edit[p][to], (REROLE + more, Rope("R")))
            if s.lower() == NEXT[p][0][0]:
                edit[p][to] = better(edit[p][to], (KEEP + more, Rope("K")))
            if s.lower() == "s" and p == 0:
                edit[p][1] = (KEEP + more, Rope("K"))
    return times(INSERTS, edit)


def matrices(rules: list[str]) -> dict[str, list[list[Entry]]]:
    """The matrices of all symbols and, bottom-up, of all rules (pairs of symbols)."""
    out = {s: symbol(s) for s in "suaoSUAOx"}
    for k, (left, right) in enumerate(rules):
        out[chr(RULE + k)] = times(out[left], out[right])
    return out


def rewritten(text: str, rules: list[str], first: int = 0) -> str:
    for k in range(first, len(rules)):
        text = text.replace(rules[k], chr(RULE + k))
    return text


def product(seq: str, known: dict) -> list[list[Entry]]:
    out = None
    for s in seq:
        out = known[s] if out is None else times(out, known[s])
    return out or [[(0, EMPTY) if p == q else None for q in STATES] for p in STATES]


# --- the grammar of all sequences -----------------------------------------------------------


def grammar(kinds: DataFrame) -> list[str]:
    """Rules (pairs of symbols or earlier rules) over the sequences ``kinds`` (seq)."""
    rules: list[str] = []
    for _ in range(ROUNDS):
        known = list(rules)

        def pairs(batches: Iterable[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = rewritten("\n".join(batch.column(0).to_pylist()), known)
                code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
                both = (code[:-1] << 32) | code[1:]
                got, n = np.unique(both[(code[:-1] != 10) & (code[1:] != 10)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n)], ["pair", "n"])

        counts = kinds.select("seq").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "pair").limit(ROUND_RULES).collect()
        if not top:
            break
        rules += [chr(r["pair"] >> 32) + chr(r["pair"] & 0xFFFFFFFF) for r in top]
    return rules


def _evaluated(rules: list[str], known: dict):
    """For each sequence its matrix: costs (null: no way) and audits, from state x 4 + to state."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            costs, audits = [], []
            for seq in rewritten("\n".join(seqs), rules).split("\n"):
                entries = [x for row in product(seq, known) for x in row]
                costs.append([x and x[0] for x in entries])
                audits.append([x and str(x[1]) for x in entries])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["seq", "costs", "audits"])

    return run


# --- rows, chunks, conversations ------------------------------------------------------------


def _rows(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).withColumn("tie", F.sha2("text", 256))


ORDER = ["conv_id", "turn", "role", "tie"]


def _facts(rows: DataFrame) -> DataFrame:
    """For each row, without its text: place in the order of all rows, turn, role class and fault."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    facts = rows.select(
        *ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "k").otherwise("t").alias("fault"),
        F.xxhash64("conv_id", "role", "text").alias("h"), F.xxhash64(F.lit(1), "text", "role", "conv_id").alias("h2"),
    )
    ordered = facts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return stored(ordered.select("conv_id", "turn", "initial", "fault", "h", "h2", F.monotonically_increasing_id().alias("place")), "ordered")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of one conversation in a chunk: symbols, counts, and what meets at the ends."""
    names = ["conv_id", *(c.split()[0] for c in PIECE.split(", "))]
    for batch in batches:
        conv, n = batch.column("conv_id"), batch.num_rows
        place = batch.column("place").to_numpy()
        same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
        null = conv.is_null().to_numpy(zero_copy_only=False)
        same = (same | (null[1:] & null[:-1])) & (place[1:] // CHUNK == place[:-1] // CHUNK)
        cut = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])
        initial, fault = "".join(batch.column("initial").to_pylist()), "".join(batch.column("fault").to_pylist())
        symbols = "".join("x" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(initial, fault, strict=True))
        i = np.frombuffer(initial.encode(), np.uint8)
        pair = (i[:-1].astype(int) << 8) | i[1:]
        wrong = np.concatenate([[0], np.cumsum(~np.isin(pair, [(ord(x) << 8) | ord(y) for x, y in ("su", "ua", "au")]))])
        turn = batch.column("turn")
        has = turn.is_valid().to_numpy(zero_copy_only=False)
        turn = pc.fill_null(turn, 0).to_numpy()
        new = has.copy()
        new[1:] &= ~((turn[1:] == turn[:-1]) & has[:-1])
        news = np.concatenate([[0], np.cumsum(new)])
        rows = []
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            f, whole = fault[a:z], np.flatnonzero(has[a:z]) + a
            turns = int(news[z] - news[a]) + int(has[a] and not new[a])
            ends = (int(turn[whole[0]]), int(turn[whole[-1]])) if len(whole) else (None, None)
            rows.append((int(place[a]), symbols[a:z], z - a, f.count("b"), f.count("d"), f.count("t"), int(wrong[z - 1] - wrong[a]), initial[a], initial[z - 1], *ends, turns))
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in PIECE.split(", ")]
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(cut[:-1])), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)


class _Fold:
    """A conversation's chunks, one after the other."""

    def __init__(self) -> None:
        self.counts, self.last, self.low, self.high, self.turns = [0, 0, 0, 0], "", None, None, 0
        self.way: list[list[Entry]] = [[(0, EMPTY), None, None, None]]

    def add(self, r: dict) -> None:
        for k, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += r[c]
        self.counts[3] += bool(self.last) and self.last + r["first"] not in ("su", "ua", "au")
        self.last = r["last"]
        if r["turns"]:
            self.turns += r["turns"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        part = [[None if c is None else (c, Rope(a)) for c, a in list(zip(r["costs"], r["audits"], strict=True))[4 * p : 4 * p + 4]] for p in STATES]
        self.way = times(self.way, part)

    def row(self) -> tuple:
        (ends,) = times(self.way, INSERTS)
        cost, audit = better(ends[ENDS[0]], ends[ENDS[1]])
        gaps = min(self.high - self.low + 1 - self.turns, LONG) if self.turns else 0
        return gaps, *self.counts, cost, str(audit)


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in AUDIT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()]
    held: tuple[object, _Fold] | None = None
    key = None
    for batch in batches:
        key, done = batch.column("conv_id").type, []
        for r in batch.to_pylist():
            if held is None or held[0] != r["conv_id"]:
                done += [held] if held else []
                held = (r["conv_id"], _Fold())
            held[1].add(r)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], key), *(pa.array(c, t) for c, t in zip(zip(*(f.row() for _, f in done), strict=True), kinds, strict=True))], ["conv_id", *names])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], key), *(pa.array([x], t) for x, t in zip(held[1].row(), kinds, strict=True))], ["conv_id", *names])


def audited(df: DataFrame) -> DataFrame:
    """A row for each conversation of ``df`` (conv_id, turn, role, text): conv_id; gaps (turns missing
    between the first and the last); blank, duplicate, truncated rows (a row's first fault counts); illegal
    (adjacent roles that may not be); cost and audit of the cheapest repair."""
    key = df.schema["conv_id"].dataType.simpleString()
    facts = _facts(_rows(df))
    firsts = stored(facts.where("fault <> 'b'").groupBy("h", "h2").agg(F.min("place").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    fault = F.when((F.col("fault") != "b") & (F.col("place") > F.col("head")), "d").otherwise(F.col("fault"))
    flagged = facts.join(firsts, ["h", "h2"], "left").select("conv_id", "turn", "initial", fault.alias("fault"), "place")
    dealt = flagged.withColumn("chunk", F.expr(f"place div {CHUNK}")).repartition("chunk").sortWithinPartitions("place")
    pieces = stored(dealt.mapInArrow(_pieces, f"conv_id {key}, {PIECE}"), "pieces")
    kinds = stored(pieces.select("seq").distinct(), "kinds")
    rules = grammar(kinds)
    costs = stored(kinds.repartition("seq").mapInArrow(_evaluated(rules, matrices(rules)), "seq string, costs array<long>, audits array<string>"), "costs")
    met = pieces.join(costs, "seq").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    out = stored(met.mapInArrow(_folded, f"conv_id {key}, {AUDIT}"), "audits")
    for old in (facts, firsts, pieces, kinds, costs):
        removed(old)
    return out


def replayed(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit makes of a conversation's rows (role, text), deleted ones too."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            role, state = NEXT[state]
        elif edit == "K":
            state = 1 if role[:1] == "s" else NEXT[state][1]
        yield edit, role, text


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's audit row, and its rows as they stream in."""

    def flat() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield from batch.slice(at, 1024).to_pylist()

    stream = flat()
    ahead = [next(stream, None)]

    def own() -> Iterator[tuple[str, str]]:
        while ahead[0] is not None and ahead[0]["part"] == 1:
            r = ahead[0]
            ahead[0] = next(stream, None)
            yield r["role"], r["text"]

    while ahead[0] is not None:
        head = ahead[0]
        ahead[0] = next(stream, None)
        rows = own()
        yield head, rows
        for _ in rows:
            pass


def _streamed(df: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit row and after it its rows, in order."""
    heads = audits.select(F.lit(0).alias("part"), "*")
    rows = _rows(df).select(F.lit(1).alias("part"), "*")
    return heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "tie")


def repaired(df: DataFrame) -> DataFrame:
    """The rows of all conversations after repair: conv_id, place (from 0), edit (K, R or I), role, text."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key
            for batch in batches:
                key = batch.column("conv_id").type
                yield batch

        def given() -> pa.RecordBatch:
            kinds = [key, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"])

        for head, rows in _conversations(typed()):
            kept = (x for x in replayed(head["audit"], rows) if x[0] != "D")
            for k, (edit, role, text) in enumerate(kept):
                held.append((head["conv_id"], k, edit, role, text))
                size += len(text)
                if len(held) >= 4096 or size > 4 << 20:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    return _streamed(df, audited(df)).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def repair_report(df: DataFrame) -> DataFrame:
    """``audited`` with repaired_sha256: of the repaired rows as ``role:text``, joined by newlines."""
    kind = df.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split()[0] for c in AUDIT.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal key
            for batch in batches:
                key = batch.column("conv_id").type
                yield batch

        def given() -> pa.RecordBatch:
            kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], [*names, "repaired_sha256"])

        for head, rows in _conversations(typed()):
            digest, between = hashlib.sha256(), b""
            for edit, role, text in replayed(head["audit"], rows):
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            held.append((*(head[c] for c in names), digest.hexdigest()))
            if len(held) >= 4096:
                yield given()
                held = []
        if held:
            yield given()

    return _streamed(df, audited(df)).mapInArrow(run, f"conv_id {kind}, {AUDIT}, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Rows of ``df`` with repeatable faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a
    row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes its role user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_fault")).where("_fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def repair_of_damaged(df: DataFrame) -> DataFrame:
    """``repair_report`` of ``damaged`` rows, with a row for each conversation of ``df``; zeros, an
    empty audit and the hash of nothing where no row is left."""
    report = repair_report(damaged(df))
    none = {c.split()[0]: F.lit("" if c.endswith("string") else 0) for c in AUDIT.split(", ")} | {"repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    every = df.select(F.col("conv_id").alias("_conv_id")).distinct()
    met = every.join(report, F.col("_conv_id").eqNullSafe(F.col("conv_id")), "left")
    return met.select(F.col("_conv_id").alias("conv_id"), *(F.coalesce(F.col(c), x.cast("string" if c in ("audit", "repaired_sha256") else "long")).alias(c) for c, x in none.items()))
