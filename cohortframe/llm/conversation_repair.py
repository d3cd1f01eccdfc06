"""Repair of the structure of conversations: the cheapest edits that give role initials (s?(ua)+)?.

Edits of a row are Keep (0), Rerole to user or assistant (3) and Delete (4);
an empty user or assistant row can be inserted anywhere (3). Blank and repeated
rows must go; a truncated row that stays costs 3 more. Among the cheapest edit
sequences the one whose initials come first in ASCII is taken.

What is left to build is one of four states (nothing yet, after s, u, a), so the
cheapest way is a Viterbi path. Conversations are cut into chunks of rows, all
worked on at once. A chunk goes backward from a speculative vector of costs to
go (zeros; the last one of a conversation from the true one). Where the vector
that the next chunk then hands over differs from the assumed one by more than
a constant, a fix-up pass runs the chunk again, until no vector changes; what
some passes leave open (rows whose costs never converge) is closed by min-plus
matrices of the open conversations' chunks. Vectors less their least cost take few values, so a step
is looked up. From the stitched backward costs each chunk traces its edits
for all four states it may be entered in; composing those maps over chunks says which one it is.

Rows that must go leave every vector as it is, so they aren't stepped through.
Equal rows are one row with a number of copies, and rows are numbered in range
partitions, so neither a repeated row nor a long conversation is gathered.
Only the SHA-256 of a repaired conversation, which is sequential by definition, is made of
its rows in one task, which streams them.

Cases: nulls count as one space; rows of one turn follow each other by role, then by SHA-256 of
the text; a null conv_id is a conversation of its own; null turns come first; blank and very long
texts are taken whole; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, released, smaller_batches, stored_at

#: Rows of a chunk, passes before matrices close what is open, rows of a range partition (about), rows broadcast at most.
CHUNK, PASSES, ROWS_A_TASK, BROADCAST_ROWS = 4096, 6, 50_000, 500_000
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3
#: States: nothing built yet, after s, after u, after a. The state an inserted row leads to, and the state that each initial leads to.
NEEDED = (2, 2, 3, 2)
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Costs to go at a conversation's end.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
#: A row's code is its initial's place here, or 3, and 4 more if it is truncated.
INITIALS = "sua"
SPACES = r"\x20\x09-\x0D"


@cache
def _step(ahead: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs to go before a row, given those after it, as a vector whose least entry is 0, and what was taken off."""
    more = CUT * (code >> 2)
    own = []
    for s in range(4):
        to = AFTER[s].get(INITIALS[code & 3 : (code & 3) + 1])
        own.append(min(DELETE + ahead[s], REROLE + more + ahead[NEEDED[s]], more + ahead[to] if to is not None else FAR))
    for _ in range(3):
        own = [min(own[s], INSERT + own[NEEDED[s]]) for s in range(4)]
    least = min(own)
    return tuple(x - least for x in own), least


@cache
def _edit(ahead: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The edits at a row, entered in a state, and the state after it: inserted roles as u or a, then the row's D, K, or U or A for its new role."""
    vector, least = _step(ahead, code)
    cost = [x + least for x in vector]
    more, out = CUT * (code >> 2), ""
    while True:
        if cost[state] == DELETE + ahead[state]:
            return out + "D", state
        if cost[state] == INSERT + cost[NEEDED[state]]:
            state = NEEDED[state]
            out += "??ua"[state]
            continue
        to = AFTER[state].get(INITIALS[code & 3 : (code & 3) + 1])
        if to is not None and cost[state] == more + ahead[to]:
            return out + "K", to
        return out + "??UA"[NEEDED[state]], NEEDED[state]


TAILS = ("", "ua", "a", "")


def backward(codes: bytes, end: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """The vectors after each row of a chunk, the one before its first row in front, and the cost taken off in all."""
    vectors, total = [end], 0
    for code in reversed(codes):
        vector, least = _step(vectors[-1], code)
        vectors.append(vector)
        total += least
    return vectors[::-1], total


def forward(codes: bytes, vectors: list[tuple[int, ...]], state: int) -> tuple[list[str], int]:
    """The edits at each row of a chunk entered in a state, and the state it is left in."""
    out = []
    for code, ahead in zip(codes, vectors[1:], strict=True):
        edit, state = _edit(ahead, code, state)
        out.append(edit)
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows that damage leaves, by CRC-32 of `conv_id:turn` modulo 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(how == 4, "user").otherwise(one("role"))
    return conversations.filter(how != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 3, 2).otherwise(1).cast("long").alias("copies"))


KEY = ["conv_id", "turn", "role", "digest"]
ROWS = "conv_id long, turn long, role string, digest binary, copies long, fault string, part long, chunk long, place int, codes binary"


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _chunked(size: int):
    """Rows in order, numbered in chunks of rows that may stay; after each chunk a row with its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, codes, conv, started = TaskContext.get().partitionId(), 0, bytearray(), None, False
        for batch in batches:
            columns = batch.to_pydict()
            out = {c.split()[0]: [] for c in ROWS.split(", ")}

            def add(out, *values):
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)

            for c, turn, role, digest, copies, fault in zip(*(columns[x] for x in (*KEY, "copies", "fault")), strict=True):
                if codes and (len(codes) == size or c != conv):
                    add(out, conv, None, None, None, 0, None, part, chunk, None, bytes(codes))
                    chunk, codes = chunk + 1, bytearray()
                conv, started = c, True
                if fault in ("blank", "duplicate"):
                    add(out, c, turn, role, digest, copies, fault, part, chunk, None, None)
                else:
                    add(out, c, turn, role, digest, copies, fault, part, chunk, len(codes), None)
                    at = INITIALS.find(role[0]) if role else -1
                    codes.append((at if at >= 0 else 3) + 4 * (fault == "truncated"))
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
        if started and codes:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(_SCHEMA.names, (conv, None, None, None, 0, None, part, chunk, None, bytes(codes)), strict=True)}, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("copies", pa.int64()), ("fault", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), ("place", pa.int32()), ("codes", pa.binary())])


def faulted(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Distinct rows (conv_id, turn, role, digest) with copies and fault: of the first copy, the others being duplicates."""
    last = F.regexp_extract("text", rf"([^{SPACES}])[{SPACES}]*\z", 1)
    fault = F.when(~F.col("text").rlike(rf"[^{SPACES}]"), "blank").when(~last.rlike(r"[.!?]"), "truncated")
    light = _with_digest(rows).select(*KEY, fault.alias("own"), "copies")
    light, path = stored_at(light.groupBy(*KEY, "own").agg(F.sum("copies").alias("copies")), "turns")
    first = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again, path2 = stored_at(first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "said-before")
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    met = light.join(few, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select(*KEY, "copies", F.when(F.col("own") == "blank", "blank").when(later, "duplicate").otherwise(F.col("own")).alias("fault")), [path, path2]


CHUNKS = "conv_id long, part long, chunk long, codes binary"
SEEN = CHUNKS + ", last boolean, end array<long>, start array<long>, cost long, leave array<int>"


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk with its vector before the first row, its cost, and the state it is left in for each one it may be entered in."""
    for batch in batches:
        out = batch.to_pydict()
        done = []
        for codes, end in zip(out["codes"], out["end"], strict=True):
            vectors, total = backward(codes, tuple(end))
            done.append((list(vectors[0]), total, [forward(codes, vectors, s)[1] for s in range(4)]))
        out |= {name: [d[i] for d in done] for i, name in enumerate(("start", "cost", "leave"))}
        yield pa.RecordBatch.from_pydict(out, schema=_SEEN)


_SEEN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("last", pa.bool_()), ("end", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("cost", pa.int64()), ("leave", pa.list_(pa.int32()))])


def _vector(values) -> F.Column:
    return F.array(*(F.lit(x).cast("long") for x in values))


def converged(chunks: DataFrame, passes: int) -> tuple[DataFrame, list[str], int]:
    """Chunks with the vectors that hold, up to constants; paths of what is written, and how many fix-up passes ran."""
    order = Window.partitionBy("conv_id").orderBy("part", "chunk")
    marked = chunks.withColumn("last", F.lead("chunk").over(order).isNull()).withColumn("end", F.when(F.col("last"), _vector(END)).otherwise(_vector((0,) * 4)))
    seen, path = stored_at(marked.select("conv_id", "part", "chunk", "codes", "last", "end").mapInArrow(_passed, SEEN), "vectors")
    paths, ran = [path], 0
    if seen.filter("not last").isEmpty():
        return seen, paths, ran
    true = F.when(F.col("last"), _vector(END)).otherwise(F.lead("start").over(order))
    while ran < passes:
        now, path = stored_at(seen.withColumn("handed", true), "handed")
        paths.append(path)
        changed = now.filter("handed <> end").select("conv_id", "part", "chunk", "codes", "last", F.col("handed").alias("end"))
        if changed.isEmpty():
            return seen, paths, ran
        seen, path = stored_at(now.filter("handed = end").drop("handed").unionByName(changed.mapInArrow(_passed, SEEN)), "vectors")
        paths.append(path)
        ran += 1
    now = seen.withColumn("handed", true)
    late = now.filter("handed <> end").select(F.col("conv_id").alias("c")).distinct()
    late, path = stored_at(late, "late")
    paths.append(path)
    if late.isEmpty():
        return seen, paths, ran
    open_rows = seen.join(late, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for codes in batch.column("codes").to_pylist():
                columns = []
                for e in range(4):
                    vectors, total = backward(codes, tuple(0 if s == e else FAR for s in range(4)))
                    columns.append([x + total for x in vectors[0]])
                own.append([columns[e][s] for s in range(4) for e in range(4)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "chunk")), pa.array(own, pa.list_(pa.int64()))], ["conv_id", "part", "chunk", "matrix"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, vector, begun = None, list(END), False
        for batch in batches:
            ends = []
            for c, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if c != conv or not begun:
                    conv, vector, begun = c, list(END), True
                ends.append(vector)
                vector = [min(matrix[4 * s + e] + vector[e] for e in range(4)) for s in range(4)]
                vector = [x - min(vector) for x in vector]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "chunk")), pa.array(ends, pa.list_(pa.int64()))], ["conv_id", "part", "chunk", "end"])

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = open_rows.select("conv_id", "part", "chunk", "codes").mapInArrow(matrices, "conv_id long, part long, chunk long, matrix array<long>")
    ends = made.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk")).mapInArrow(fold, "conv_id long, part long, chunk long, end array<long>")
    again = open_rows.drop("end", "start", "cost", "leave", "conv_id").join(ends, ["part", "chunk"]).select("conv_id", "part", "chunk", "codes", "last", "end").mapInArrow(_passed, SEEN)
    closed = seen.join(late, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    seen, path = stored_at(closed.unionByName(again), "vectors")
    return seen, [*paths, path], ran


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, each with the state in which it is entered, the cost of its conversation at the first, the closing inserts at the last."""
    conv, state, begun = None, 0, False
    for batch in batches:
        rows = batch.to_pydict()
        enter, tail = [], []
        for c, leave, last in zip(rows["conv_id"], rows["leave"], rows["last"], strict=True):
            if c != conv or not begun:
                conv, state, begun = c, 0, True
            enter.append(state)
            state = leave[state]
            tail.append(TAILS[state] if last else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "chunk")), pa.array(enter, pa.int32()), pa.array(tail, pa.string())], ["part", "chunk", "enter", "tail"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        edits = []
        for codes, end, state in zip(rows["codes"], rows["end"], rows["enter"], strict=True):
            vectors, _ = backward(codes, tuple(end))
            edits.append(forward(codes, vectors, state)[0])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "chunk", "tail")), pa.array(edits, pa.list_(pa.string()))], ["conv_id", "part", "chunk", "tail", "edits"])


EDITS = "conv_id long, tail boolean, turn long, role string, digest binary, copies long, fault string, edits string"


def edits(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> tuple[DataFrame, list[str]]:
    """The edits at each distinct row of (conv_id, turn, role, text, copies), and a row with tail true for a conversation's closing inserts.

    edits names inserted roles as u or a and then the first copy's edit: K, D, or U or A for a new role; all other copies go."""
    spark = rows.sparkSession
    smaller_batches(spark)
    light, paths = faulted(rows)
    found, path = stored_at(light, "faults")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // ROWS_A_TASK)
    ordered = found.repartitionByRange(tasks, *KEY).sortWithinPartitions(*KEY).select(*KEY, "copies", "fault").mapInArrow(_chunked(chunk), ROWS)
    ordered, path2 = stored_at(ordered, "ordered")
    seen, more, _ = converged(ordered.filter("codes is not null").select("conv_id", "part", "chunk", "codes"), passes)
    entered = seen.select("conv_id", "part", "chunk", "leave", "last").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(_entered, "part long, chunk long, enter int, tail string")
    traced = seen.join(entered, ["part", "chunk"]).select("conv_id", "part", "chunk", "codes", "end", "enter", "tail").mapInArrow(_traced, "conv_id long, part long, chunk long, tail string, edits array<string>")
    traced, path3 = stored_at(traced, "traced")
    each = traced.select("part", "chunk", F.posexplode("edits").alias("place", "edits"))
    own = ordered.filter("codes is null").join(each, ["part", "chunk", "place"], "left").withColumn("edits", F.coalesce("edits", F.lit("D")))
    tails = traced.filter("tail <> ''").select("conv_id", F.lit(True).alias("tail"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("copies", "long"), ("fault", "string"))), F.col("tail").alias("edits"))
    out = own.select("conv_id", F.lit(False).alias("tail"), "turn", "role", "digest", "copies", "fault", "edits").unionByName(tails)
    done, path4 = stored_at(out, "edits")
    discard(spark, *paths, path, path2, path3, *more)
    released(spark)
    return done, [path4]


ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
ORDER = ["conv_id", "tail", "turn", "role", "digest", "kind"]


def _edited(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits (kind 0) and texts (kind 1) in one table."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    plans = found.select("conv_id", "tail", "turn", "role", "digest", F.lit(0).alias("kind"), "copies", "fault", "edits", none("text", "string"))
    texts = _with_digest(rows).select("conv_id", F.lit(False).alias("tail"), "turn", "role", "digest", F.lit(1).alias("kind"), none("copies", "long"), none("fault", "string"), none("edits", "string"), "text")
    return plans.unionByName(texts)


def repaired_rows(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """The repaired conversations: conv_id, turn, role, text and edit (K, R or I) of every row that they have, where
    tail (closing inserts), turn, role_before, digest and place are their order. Each row's task needs its own key alone."""
    found, _ = edits(rows, chunk, passes)
    texts = _with_digest(rows).groupBy(*KEY).agg(F.first("text").alias("text"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in KEY]
    met = found.filter("edits <> 'D'").alias("e").join(texts.alias("t"), same[0] & same[1] & same[2] & same[3], "left")
    letters = F.expr("explode(transform(sequence(1, length(e.edits)), i -> struct(i AS place, substr(e.edits, i, 1) AS letter)))")
    each = met.select("e.conv_id", "e.tail", "e.turn", F.col("e.role").alias("role_before"), "e.digest", "t.text", letters.alias("x")).filter("x.letter <> 'D'")
    letter = F.col("x.letter")
    role = F.when(letter.isin("u", "U"), "user").when(letter.isin("a", "A"), "assistant").otherwise(F.col("role_before"))
    edit = F.when(letter == "K", "K").when(letter.isin("U", "A"), "R").otherwise("I")
    return each.select("conv_id", "tail", "turn", "role_before", "digest", F.col("x.place").alias("place"), edit.alias("edit"), role.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


DIGEST = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
LEGAL = {"su", "ua", "au"}


class _Digest:
    """One conversation while its rows stream by."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.turns, self.least, self.most, self.turn = 0, None, None, None
        self.audit, self.sha, self.initial, self.lines, self.pending = [], hashlib.sha256(), None, 0, None

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * (self.lines > 0) + role + ":").encode("utf-8", "replace"))
        self.sha.update(text.encode("utf-8", "replace"))
        self.lines += 1

    def planned(self, turn, role, copies, fault, edits) -> None:
        if copies is not None:
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns, self.most, self.turn = self.turns + (turn != self.turn), turn, turn
            self.blank += copies if fault == "blank" else 0
            self.duplicate += copies if fault == "duplicate" else 0 if fault == "blank" else copies - 1
            self.truncated += fault == "truncated"
            initial = role[:1]
            self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + (copies - 1) * (2 * initial not in LEGAL)
            self.initial = initial
        for x in edits:
            if x in "ua":
                self.line(ROLES[x], "")
                self.audit.append("I")
                self.cost += INSERT
            else:
                self.audit.append(x if x in "KD" else "R")
                self.cost += {"K": 0, "D": DELETE}.get(x, REROLE) + (CUT if fault == "truncated" and x != "D" else 0)
        if copies is not None:
            self.audit.append("D" * (copies - 1))
            self.cost += DELETE * (copies - 1)
            own = edits[-1]
            self.pending = None if own == "D" else ROLES.get(own, role)

    def said(self, text: str) -> None:
        if self.pending is not None:
            self.line(self.pending, text)
            self.pending = None

    def row(self, conv) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, own = None, None

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), DIGEST.types, strict=True)], schema=DIGEST)

    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "copies", "fault", "edits", "text")]
        for c, kind, turn, role, copies, fault, letters, text in zip(*columns, strict=True):
            if own is None or c != conv:
                if own is not None:
                    done.append(own.row(conv))
                conv, own = c, _Digest()
            if kind == 0:
                own.planned(turn, role, copies, fault, letters)
            elif kind == 1:
                own.said(text)
        if done:
            yield table(done)
    if own is not None:
        yield table([own.row(conv)])


def repair_digests(conversations: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """Of every conv_id of the damaged conversations: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    spark = conversations.sparkSession
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = damaged(plain)
    found, _ = edits(rows, chunk, passes)
    streamed = _edited(found, rows)
    every = plain.select("conv_id").distinct().select("conv_id", F.lit(False).alias("tail"), *(F.lit(None).cast(streamed.schema[c].dataType).alias(c) for c in ("turn", "role", "digest")), F.lit(2).alias("kind"), *(F.lit(None).cast(streamed.schema[c].dataType).alias(c) for c in ("copies", "fault", "edits", "text")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // ROWS_A_TASK)
    dealt = streamed.unionByName(every).repartition(tasks, "conv_id").sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "kind", "turn", "role", "copies", "fault", "edits", "text").mapInArrow(_digested, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
