"""Conversation structure repair by weighted CYK interval parsing (operator 11).

Role initials of a repaired conversation have to read ``(s?(ua)+)?``. The grammar's nonterminals are pairs [p, q]
of the states of that language: [p, q] derives what leads from p to q. Its rules are [p, q] -> [p, r] [r, q] (Chomsky
normal form) and, for single rows, the weighted edits: Keep 0, Rerole 1, Delete 2, Insert 5, and 5 more for a
truncated row that stays. Inserts stand before and after each row's edit (the insertion closure). The cell of an interval has
for each nonterminal the least (cost, audit); as no audit of a cell is a proper prefix of another of the same cost,
least parts make least wholes, and every split of an interval gives the same cell. So one split of each interval is
enough: intervals double in length, bottom-up.

Rows get positions by one range sort; a conversation's rows of one block of BLOCK positions are a piece, and pieces are
combined FAN at a time, so a conversation of any length is parsed in many tasks. Only its audit, which the result has as
one text, and the digest of its repaired text, which streams through one task chunk by chunk, are as long as it is.

Nulls count as one space (a null text is blank, a null role is no role), but the null ``conv_id`` is a conversation of its
own and null turns come first and leave no gaps. Rows of one turn come by role and text (64 characters, then digest), repeated rows
are duplicates of the first. Very long texts never enter Python. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repocensus.llm.tables import arrow_batches, stored

BLOCK_BITS = 8
FAN_BITS = 6
SALTS = 8
SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system row, after a user row, after an assistant row. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REACHED = {START: (START, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
NONTERMINALS = [(p, q) for p in range(4) for q in REACHED[p]]
NUMBER = {pair: i for i, pair in enumerate(NONTERMINALS)}
RULES = [[(NUMBER[p, r], NUMBER[r, q], r) for r in REACHED[p] if q in REACHED[r]] for p, q in NONTERMINALS]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# A cell has for each nonterminal (cost, audit, states where its pieces meet), or None.
Cell = list


def _steps(edits: list[tuple[int, int, int, str]]) -> Cell:
    cell: Cell = [None] * len(NONTERMINALS)
    for p, q, cost, audit in edits:
        new, old = (cost, audit, ""), cell[NUMBER[p, q]]
        cell[NUMBER[p, q]] = new if old is None else min(old, new)
    return cell


def joined(left: Cell, right: Cell, meeting: bool = False) -> Cell:
    """The cell of two neighbouring intervals; ``meeting`` notes the state between them."""
    out: Cell = []
    for rules in RULES:
        best = None
        for i, j, state in rules:
            a, b = left[i], right[j]
            if a is None or b is None or (best is not None and a[0] + b[0] > best[0]):
                continue
            new = (a[0] + b[0], a[1] + b[1], a[2] + str(state) + b[2] if meeting else "")
            if best is None or new[:2] < best[:2]:
                best = new
        out.append(best)
    return out


def _closure() -> Cell:
    """What inserts alone derive."""
    still = [(p, p, 0, "") for p in range(4)]
    once = _steps(still + [(p, q, INSERT, "I") for (p, by), q in NEXT.items() if by != "s"])
    return joined(once, once)


INSERTS = _closure()


@functools.lru_cache(64)
def _row(kind: str) -> Cell:
    """The cell of one row: its role's initial, upper case if truncated, or ``x`` if it has to go."""
    edits = [(p, p, DELETE, "D") for p in range(4)]
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        for (p, by), q in NEXT.items():
            if by == kind.lower():
                edits.append((p, q, KEEP + more, "K"))
            if by != "s":
                edits.append((p, q, REROLE + more, "R"))
    return joined(joined(INSERTS, _steps(edits)), INSERTS)


@functools.lru_cache(20_000)
def _short(kinds: str) -> Cell:
    return chart([_row(k) for k in kinds])


def chart(cells: list[Cell], meeting: bool = False) -> Cell:
    """The cell of a whole row of intervals; lengths double from one round to the next."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2], meeting) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parsed(kinds: str) -> Cell:
    """The cell of some rows' kinds."""
    return chart([_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def least(cell: Cell) -> tuple[int, str, str, int]:
    """Cost, audit, meeting states and last state of the cheapest way through a whole conversation."""
    return min((*cell[NUMBER[START, q]], q) for q in (START, ASSISTANT) if cell[NUMBER[START, q]])


def replayed(kinds: str, audit: str, state: int) -> list[dict]:
    """For each row of a piece that begins in ``state``: lines before it, a new role, whether it stays, lines after it."""
    rows: list[dict] = []
    waiting: list[str] = []
    for letter in audit:
        by, role = ("a", "assistant") if state == USER else ("u", "user")
        if letter == "I":
            waiting.append(f"{role}:")
        else:
            if letter == "K":
                by = kinds[len(rows)].lower()
            rows.append({"before": waiting, "role": role if letter == "R" else None, "stays": letter != "D", "after": []})
            waiting = []
        if letter != "D":
            state = NEXT[state, by]
    rows[-1]["after"] = waiting
    return rows


CELL = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("meets", T.StringType())]))
PIECE = T.StructType([T.StructField("cell", CELL), T.StructField("illegal", T.LongType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])
WHOLE = T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("states", T.ArrayType(T.IntegerType())), T.StructField("illegal", T.LongType())])
EDITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("before", T.ArrayType(T.StringType())),
            T.StructField("role", T.StringType()),
            T.StructField("stays", T.BooleanType()),
            T.StructField("after", T.ArrayType(T.StringType())),
        ]
    )
)
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")


def _or_none(fault: Column) -> Column:
    return F.coalesce(fault, F.lit("none"))


def _as_dicts(cell: Cell) -> list:
    return [None if c is None else {"cost": c[0], "audit": c[1], "meets": c[2]} for c in cell]


def _as_cell(dicts: list) -> Cell:
    return [None if d is None else (d["cost"], d["audit"], d["meets"]) for d in dicts]


@F.arrow_udf(PIECE)
def _pieces(kinds: pa.Array, initials: pa.Array) -> pa.Array:
    out = []
    for k, i in zip(kinds.to_pylist(), initials.to_pylist(), strict=True):
        wrong = sum(i[at : at + 2] not in LEGAL for at in range(len(i) - 1))
        out.append({"cell": _as_dicts(parsed(k)), "illegal": wrong, "first": i[0], "last": i[-1]})
    return pa.array(out, to_arrow_type(PIECE))


@F.arrow_udf(PIECE)
def _combined(pieces: pa.Array) -> pa.Array:
    out = []
    for row in pieces.to_pylist():
        wrong = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(row, row[1:], strict=False))
        cell = chart([_as_cell(p["cell"]) for p in row], meeting=True)
        out.append({"cell": _as_dicts(cell), "illegal": wrong + sum(p["illegal"] for p in row), "first": row[0]["first"], "last": row[-1]["last"]})
    return pa.array(out, to_arrow_type(PIECE))


@F.arrow_udf(WHOLE)
def _chosen(pieces: pa.Array) -> pa.Array:
    out = []
    for piece in pieces.to_pylist():
        cost, audit, meets, last = least(_as_cell(piece["cell"]))
        out.append({"cost": cost, "audit": audit, "states": [START, *map(int, meets), last], "illegal": piece["illegal"]})
    return pa.array(out, to_arrow_type(WHOLE))


@F.arrow_udf(EDITS)
def _edits(kinds: pa.Array, cells: pa.Array, states: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for k, cell, p, q in zip(kinds.to_pylist(), cells.to_pylist(), states.to_pylist(), ends.to_pylist(), strict=True):
        out.append(replayed(k, cell[NUMBER[p, q]]["audit"], p))
    return pa.array(out, to_arrow_type(EDITS))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of a conversation table after the damage of the contract."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    dealt = rows.select(
        "conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"),
        F.pmod(F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")), F.lit(20)).alias("how"),
    )
    times = F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1)
    return dealt.select(
        "conv_id",
        "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("again"),
    ).drop("again")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``, which grows by conversation, turn, role and text; ``mark`` stands for role and text."""
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    keyed = rows.select("*", mark.alias("mark"), F.monotonically_increasing_id().alias("at"))
    # Short keys, unlike for equal rows too: neither a conversation nor a turn nor copies of a row stay in one task.
    keys = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "mark", "at"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    last = F.rtrim("text", F.lit(SPACE))
    return inside.select(
        "conv_id", "turn", "role", "text", "mark",
        F.monotonically_increasing_id().alias("pos"),
        (last == "").alias("blank"),
        (~F.substring(last, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )


def _block(pos: Column) -> Column:
    return F.shiftright(pos, BLOCK_BITS)


def _marked(rows: DataFrame) -> DataFrame:
    """(``conv_id``, ``pos``, ``fault``, ``initial``) of ordered rows; the first fault counts."""
    firsts = rows.where("NOT blank").groupBy("conv_id", "mark").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = firsts.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    narrow = rows.select("conv_id", "pos", "mark", "blank", "truncated", F.substring("role", 1, 1).alias("role"), F.pmod("pos", F.lit(SALTS)).cast("int").alias("salt"))
    met = narrow.join(salted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")) & (F.col("salt") == F.col("s")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("pos"), "duplicate").when(F.col("truncated"), "truncated")
    return met.select("conv_id", "pos", fault.alias("fault"), F.when(F.col("role").isin("s", "u", "a"), F.col("role")).otherwise("o").alias("initial"))


def _wholes(pieces: DataFrame, bits: int) -> DataFrame:
    """(``conv_id``, ``blocks``, ``w``) of every conversation; ``bits`` is the number of bits that blocks have."""
    many = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    narrow = pieces.select("conv_id", F.col("block").alias("key"), "piece")
    level = narrow.join(many, same, "left_semi").withColumn("blocks", F.array("key"))
    for _ in range(0, bits, FAN_BITS):
        grouped = level.groupBy("conv_id", F.shiftright("key", FAN_BITS).alias("key")).agg(F.sort_array(F.collect_list(F.struct("blocks", "piece"))).alias("of"))
        level = grouped.select("conv_id", "key", _combined("of.piece").alias("piece"), F.flatten("of.blocks").alias("blocks"))
    single = narrow.join(many, same, "left_anti").select("conv_id", F.array("key").alias("blocks"), "piece")
    return single.unionByName(level.select("conv_id", "blocks", "piece")).select("conv_id", "blocks", _chosen("piece").alias("w"))


def _digests(chunks: DataFrame) -> DataFrame:
    """(``c``, ``digest``): SHA-256 of each conversation's chunks (``conv_id``, ``block``, ``chunk``) in order, newline-joined."""
    schema = T.StructType([chunks.schema["conv_id"], T.StructField("digest", T.StringType())])

    def run(batches):
        now, digest, ids, found = (), hashlib.sha256(), [], []
        for batch in batches:
            for conv, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != (conv,):
                    if now:
                        ids.append(now[0])
                        found.append(digest.hexdigest())
                    now, digest, between = (conv,), hashlib.sha256(), b""
                if chunk:
                    digest.update(between + chunk.encode())
                    between = b"\n"
        if now:
            ids.append(now[0])
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string())], ["conv_id", "digest"])

    kind = to_arrow_type(schema["conv_id"].dataType)
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.select("conv_id", "chunk").mapInArrow(run, schema)


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and their repaired text.

    The first table has a row for each conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``): counts of
    faults, ``cost`` and ``audit``. The second has repaired lines (``conv_id``, ``block``, ``chunk``): newline-joined
    ``role:text``, null where nothing is left, in the order of the blocks.
    """
    arrow_batches(rows.sparkSession)
    table = stored(_ordered(rows), "repair-rows", shuffles_go=True)
    marked = _marked(table)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    letters = F.sort_array(F.collect_list(F.struct("pos", kind.alias("kind"), "initial", "fault"))).alias("l")
    grouped = marked.groupBy("conv_id", _block(F.col("pos")).alias("block")).agg(letters)
    counts = [(F.size("l") - F.size(F.array_remove(F.transform("l.fault", _or_none), name))).cast("long").alias(name) for name in FAULTS]
    kinds = F.array_join("l.kind", "").alias("kinds")
    pieces = stored(
        grouped.select("conv_id", "block", kinds, *counts, _pieces(F.array_join("l.kind", ""), F.array_join("l.initial", "")).alias("piece")),
        "repair-pieces",
        shuffles_go=True,
    )
    top = pieces.agg(F.max("block")).first()[0] or 0
    wholes = stored(_wholes(pieces, top.bit_length()), "repair-wholes", shuffles_go=True)

    turns = table.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    sums = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in FAULTS])
    found = wholes.select("conv_id", F.col("w.illegal").alias("illegal"), F.col("w.cost").alias("cost"), F.col("w.audit").alias("audit"))
    for more in (gaps, sums):
        found = found.join(more.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    # Every piece's way through its cell, then its rows' edits.
    way = wholes.select(F.col("conv_id").alias("c"), F.posexplode("blocks").alias("i", "b"), F.col("w.states").alias("states"))
    ways = way.select("c", "b", F.get("states", F.col("i")).alias("p"), F.get("states", F.col("i") + 1).alias("q"))
    edits = pieces.join(ways, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(
        "c", "b", _edits("kinds", "piece.cell", "p", "q").alias("edits")
    )
    texts = table.groupBy("conv_id", _block(F.col("pos")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    lines = F.flatten(
        F.zip_with(
            "rows",
            "edits",
            lambda r, e: F.concat(e.before, F.when(e.stays, F.array(F.concat(F.coalesce(e.role, r.role), F.lit(":"), r.text))).otherwise(F.array().cast("array<string>")), e.after),
        )
    )
    both = texts.join(edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    chunks = both.select("conv_id", "block", lines.alias("lines")).select("conv_id", "block", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("chunk"))
    return found, chunks


def repair_query(rows: DataFrame) -> DataFrame:
    """One row for each ``conv_id``, those without rows after the damage too."""
    found, chunks = repaired(damaged(rows))
    chunks = stored(chunks, "repair-chunks", shuffles_go=True)
    sizes = chunks.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), "n")
    of = chunks.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    alone = of.where("n = 1").select("conv_id", F.sha2(F.coalesce("chunk", F.lit("")).cast("binary"), 256).alias("digest"))
    digests = alone.unionByName(_digests(of.where("n > 1"))).withColumnRenamed("conv_id", "c")
    known = found.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    named = every.join(known, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.select(
        F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )


REPAIR_SQL = r"""
WITH RECURSIVE bits(b, c, step) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256) UNION ALL
       SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE step = 8),
g AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT g.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)),
             lambda x, y: xor(x // 256, tab[xor(x % 256, y) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS how FROM g, crc),
d AS (SELECT cid, turn, CASE WHEN how = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
             CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
             unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, again) AS i, left(role, 1) AS initial,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ends FROM d),
f AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
             lag(initial) OVER (PARTITION BY cid ORDER BY i) AS before FROM o),
ins(p, q, c, a, x) AS (VALUES ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('0', 'u', 5, 'I', ['user:']),
       ('s', 'u', 5, 'I', ['user:']), ('a', 'u', 5, 'I', ['user:']), ('u', 'a', 5, 'I', ['assistant:']), ('0', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 'a', 10, 'II', ['user:', 'assistant:'])),
edit(p, letter, needs, q, c) AS (VALUES ('0', 'D', '', '0', 2), ('s', 'D', '', 's', 2), ('u', 'D', '', 'u', 2), ('a', 'D', '', 'a', 2), ('0', 'K', 's', 's', 0), ('0', 'K', 'u', 'u', 0),
       ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('0', 'R', '', 'u', 1), ('s', 'R', '', 'u', 1), ('a', 'R', '', 'u', 1), ('u', 'R', '', 'a', 1)),
way(cid, i, q, c, a, x) AS (
       SELECT cid, CAST(0 AS BIGINT), q, c, a, x FROM (SELECT DISTINCT cid FROM f), ins WHERE p = '0'
       UNION ALL
       SELECT cid, i, q, c, a, x FROM (
         SELECT w.cid, f.i, n.q, w.c + e.c + n.c + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS c, w.a || e.letter || n.a AS a,
                list_concat(list_concat(w.x, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END), n.x) AS x
         FROM way w JOIN f ON f.cid = w.cid AND f.i = w.i + 1 JOIN edit e ON e.p = w.q AND (e.needs = '' OR e.needs = f.initial) AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
         JOIN ins n ON n.p = e.q)
       QUALIFY row_number() OVER (PARTITION BY cid, q ORDER BY c, a) = 1),
fin AS (SELECT w.* FROM way w JOIN (SELECT cid, max(i) AS n FROM f GROUP BY 1) m ON m.cid = w.cid AND m.n = w.i WHERE w.q IN ('0', 'a')
        QUALIFY row_number() OVER (PARTITION BY w.cid ORDER BY c, a) = 1),
s AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(c, 0) AS BIGINT) AS cost, coalesce(a, '') AS audit, sha256(coalesce(array_to_string(x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM g) v LEFT JOIN s USING (cid) LEFT JOIN fin USING (cid)
"""
