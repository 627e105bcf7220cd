"""Cheapest repair of damaged conversations by shortest paths with small integer costs.

The rows of a conversation, in order, are read by a small automaton for the roles
``(s?(ua)+)?``. Edits are arcs: keep a row, give it the role that is due, delete it,
or insert the message that is due. Distances to the end are found backward by Dial's
bucket queue, since all arcs cost a few units; the repair is then the walk along
tight arcs that takes the least letter at each step, so of all cheapest repairs the
first in the order of letters.

A conversation may be of any length. Rows are dealt by ranges of (conversation,
turn, role, text) and cut into pieces of bounded size; each piece gives the costs
from each state at its start to each state at its end, a short chain of these
gives the distances at the cuts, and pieces are then walked by themselves from each
state, of which the chain picks one.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import dealt_left_join
from .store import cut, parts, table

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: Rows of a piece: a power of two.
PIECE_BITS = 10
#: Rows whose texts are joined at a time for a digest: a power of two.
CHUNK_BITS = 6
_BRIEF = 32
BLANKS = " \t\n\x0b\x0c\r"
# States: nothing yet, after a system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_DUE = (USER, USER, ASSISTANT, USER)
_FIRST_LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = ("", "system", "user", "assistant")
# Letters of a row: its role's initial if sound, the capital if unfinished, a digit if it has to go.
SOUND, CUT_SHORT, GONE = "sua-", "SUA+", "0123"
#: What it costs to end in each state, by inserts.
AT_END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 60


def _after(state: int, letter: str) -> int | None:
    """The state after a row of this role's initial, if it may stand there."""
    to = _FIRST_LETTER.get(letter)
    return to if to is not None and (to == _DUE[state] or (to, state) == (SYSTEM, BEGIN)) else None


@lru_cache(maxsize=64)
def _arcs(letter: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the arcs (edit, cost, next state) that use up a row with this letter, by edit."""
    out = []
    for state in range(4):
        arcs = [("D", DELETE, state)]
        if letter not in GONE:
            more = UNFINISHED if letter in CUT_SHORT else 0
            kept = _after(state, letter.lower())
            if kept is not None:
                arcs.append(("K", KEEP + more, kept))
            arcs.append(("R", REROLE + more, _DUE[state]))
        out.append(tuple(arcs))
    return tuple(out)


def distances(code: str, ends: tuple[int, ...]) -> list[list[int]]:
    """Least cost from (row, state) to the end of ``code``, where ending in a state costs ``ends`` more; by Dial's buckets.

    A node is 4 row + state. Buckets are held for the distances that are in use; arcs
    cost at most 3, so few are at a time.
    """
    n = len(code)
    into: list[list[tuple[int, int]]] = [[] for _ in range(4 * n + 4)]
    for i, letter in enumerate(code):
        for state, arcs in enumerate(_arcs(letter)):
            for _, cost, to in arcs:
                into[4 * i + 4 + to].append((4 * i + state, cost))
            into[4 * i + _DUE[state]].append((4 * i + state, INSERT))
    dist = [_FAR] * (4 * n + 4)
    buckets: dict[int, list[int]] = {}
    for state, end in enumerate(ends):
        if end < _FAR:
            dist[4 * n + state] = end
            buckets.setdefault(end, []).append(4 * n + state)
    at = min(buckets, default=0)
    while buckets:
        if at not in buckets:  # ends may lie far apart
            at = min(buckets)
        todo = buckets[at]
        while todo:
            node = todo.pop()
            if dist[node] == at:
                for before, cost in into[node]:
                    if at + cost < dist[before]:
                        dist[before] = at + cost
                        (todo if not cost else buckets.setdefault(at + cost, [])).append(before)
        del buckets[at]
        at += 1
    return [dist[4 * i : 4 * i + 4] for i in range(n + 1)]


@lru_cache(maxsize=20_000)
def transfer(code: str) -> tuple[int, ...]:
    """Costs from state i at the start to state j right after the last row, at 4 i + j."""
    to = [distances(code, tuple(0 if s == j else _FAR for s in range(4)))[0] for j in range(4)]
    return tuple(to[j][i] for i in range(4) for j in range(4))


@lru_cache(maxsize=20_000)
def walks(code: str, ends: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """(cost, edits, state at the end) of the least cheapest walk from each of the four states."""
    dist = distances(code, ends)
    edits, last = [], []
    for start in range(4):
        state, path, i = start, [], 0
        while i < len(code):
            here, after = dist[i][state], dist[i + 1]
            # in the order of letters: delete, insert, keep, give a role
            (d, cost, to), *rest = _arcs(code[i])[state]
            if here != cost + after[to]:
                if here == INSERT + dist[i][_DUE[state]]:
                    path.append("I")
                    state = _DUE[state]
                    continue
                d, cost, to = next(arc for arc in rest if here == arc[1] + after[arc[2]])
            path.append(d)
            state, i = to, i + 1
        edits.append("".join(path))
        last.append(state)
    return tuple(dist[0]), tuple(edits), tuple(last)


def closing(state: int) -> str:
    """Inserts after the last row."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def _int(value: Column) -> Column:
    return value.cast("long")


def faults(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text) to (key, turn, role, text, copy, fault): blank, duplicate, truncated or null, the first that holds.

    ``key`` is a string that is not null. Null roles and texts are one space. A row is a
    duplicate if its role and text stood earlier in the conversation, in the order of
    turn (nulls first), role and text; rows that are equal in all are told apart, so that
    one of them is the first. Equal rows are counted before anything else, so no number
    of them meets in a task.
    """
    plain = rows.select("key", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    runs = plain.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("copies"))
    runs = cut(runs.withColumn("said", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))), "repair-runs")
    when = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = runs.groupBy("key", "said").agg(F.min(when).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = dealt_left_join(runs, first, ["key", "said"], F.col("turn"))
    later = F.coalesce(F.col("first") != when, F.lit(False))
    each = met.select("key", "turn", "role", "text", later.alias("later"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    bare = F.rtrim("text", F.lit(BLANKS))
    blank, dup, short = bare == "", F.col("later") | (F.col("copy") > 1), ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    return each.select("key", "turn", "role", "text", "copy", F.when(blank, "blank").when(dup, "duplicate").when(short, "truncated").alias("fault"))


def ordered(rows: DataFrame) -> DataFrame:
    """``faults`` with seq: rising in the order of key, turn (nulls first), role, text and copy.

    Rows go by ranges of the whole order, so no conversation has to fit in a task. Long
    texts stand in ranges by their beginnings, since samples of them go to the driver.
    """
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role")]
    brief = F.char_length("text") <= _BRIEF  # such a text is its own beginning, and longer ones come after it
    ranges = [*order, F.substring("text", 1, _BRIEF), F.when(brief, F.col("copy")).otherwise(F.lit((1 << 31) - 1))]
    dealt = rows.repartitionByRange(parts(rows.sparkSession), *ranges).sortWithinPartitions(*order, "text", "copy")
    return cut(dealt.withColumn("seq", F.monotonically_increasing_id()), "repair-rows")


def letters() -> Column:
    known = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    place = F.when((F.char_length("role") == 0) | (known == 0), 4).otherwise(known)
    of = lambda s: F.substring(F.lit(s), place, F.lit(1))  # noqa: E731
    return F.when(F.col("fault").isin("blank", "duplicate"), of(GONE)).when(F.col("fault") == "truncated", of(CUT_SHORT)).otherwise(of(SOUND))


def _pieces(rows: DataFrame) -> DataFrame:
    """(key, piece, first, code): the rows of a conversation within a block of seqs as letters, and their seqs."""
    at = F.struct("seq", letters().alias("c"))
    piece = F.shiftright("seq", PIECE_BITS).alias("piece")
    some = rows.groupBy("key", piece).agg(F.sort_array(F.collect_list(at)).alias("all"))
    return some.select("key", "piece", F.transform("all", lambda r: r["seq"]).alias("seqs"), F.array_join(F.transform("all", lambda r: r["c"]), "").alias("code"))


def _illegal(code: str) -> int:
    plain = code.translate(_TO_ROLE)
    return sum(plain[i : i + 2] not in ("su", "ua", "au") for i in range(len(plain) - 1))


_TO_ROLE = str.maketrans("SUA+0123", "sua-sua-")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ordered`` rows to (key, cost, audit, illegal), one row a conversation, and (key, seq, at, edit, role, text), the repaired conversations.

    ``audit``: initials of the edits in order (Keep, Rerole, Delete, Insert). In the
    second table rows go by (seq, at); inserted messages have an empty text. An audit is
    one row, so it has to fit in a row; nothing else grows with a conversation but the
    chain of its pieces, 16 numbers for 1,024 rows.
    """
    pieces = cut(_pieces(rows), "repair-pieces")
    many = pieces.groupBy("key").agg(F.count("*").alias("k"), F.max("piece").alias("last"))

    @F.pandas_udf("array<long>")
    def costs(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: list(transfer(c)))

    @F.pandas_udf("array<struct<piece: long, ends: array<long>>>")
    def at_cuts(chain: pd.Series) -> pd.Series:
        def back(links):
            ends, out = list(AT_END), []
            for link in sorted(links, key=lambda r: -r["piece"]):
                out.append({"piece": link["piece"], "ends": ends})
                t = link["t"]
                ends = [min(int(t[4 * i + j]) + ends[j] for j in range(4)) for i in range(4)]
            return out

        return chain.map(back)

    split = pieces.join(many.where("k > 1").select("key"), "key", "left_semi").select("key", F.struct("piece", costs("code").alias("t")).alias("link"))
    cuts = split.groupBy("key").agg(F.collect_list("link").alias("chain")).select("key", F.explode(at_cuts("chain")).alias("e")).select("key", "e.piece", "e.ends")

    @F.pandas_udf("cost array<long>, edits array<string>, state array<int>, illegal long")
    def walked(codes: pd.Series, ends: pd.Series) -> pd.DataFrame:
        found = [(*walks(c, tuple(map(int, e)) if e is not None else AT_END), _illegal(c)) for c, e in zip(codes, ends, strict=True)]
        return pd.DataFrame([tuple(map(list, f[:3])) + f[3:] for f in found], columns=["cost", "edits", "state", "illegal"])

    done = cut(pieces.join(cuts, ["key", "piece"], "left").withColumn("w", walked("code", "ends")).select("key", "piece", "seqs", "code", "w"), "repair-walks")
    # the state at each piece's start, from those before it; pieces of a conversation are few
    link = F.struct("piece", F.col("w.state").alias("state"), F.substring("code", 1, 1).alias("a"), F.substring("code", -1, 1).alias("z"))
    start = F.struct(F.lit(BEGIN).alias("state"), F.array().cast("array<struct<piece: long, state: int>>").alias("out"))
    step = lambda acc, p: F.struct(F.get(p["state"], acc["state"]).alias("state"), F.concat(acc["out"], F.array(F.struct(p["piece"].alias("piece"), acc["state"].alias("state")))).alias("out"))  # noqa: E731
    chained = done.groupBy("key").agg(F.sort_array(F.collect_list(link)).alias("links")).withColumn("run", F.aggregate("links", start, step))
    plain = lambda c: F.translate(c, "SUA+0123", "sua-sua-")  # noqa: E731
    seams = F.size(F.filter(F.zip_with(F.slice("links", 1, F.size("links") - 1), F.slice("links", 2, F.size("links")), lambda a, b: plain(F.concat(a["z"], b["a"]))), lambda p: ~p.isin("su", "ua", "au")))
    entry = chained.select("key", F.explode("run.out").alias("e")).select("key", "e.piece", F.col("e.state").alias("entry"))
    whole = chained.select("key", F.when(F.size("links") > 1, seams).otherwise(0).cast("long").alias("seams"), F.col("run.state").alias("ended"))
    taken = cut(done.join(entry, ["key", "piece"]).select("key", "piece", "seqs", "code", "entry", F.get("w.edits", F.col("entry")).alias("edits"), F.get("w.cost", F.col("entry")).alias("cost"), F.col("w.illegal").alias("illegal")), "repair-taken")
    tail = F.element_at(F.array(*[F.lit(closing(s)) for s in range(4)]), F.col("ended") + 1)
    audits = taken.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "edits"))), lambda p: p["edits"]), "").alias("edits"), F.min_by("cost", "piece").alias("cost"), F.sum("illegal").alias("illegal"))
    verdicts = audits.join(whole, "key").select("key", "cost", F.concat("edits", tail).alias("audit"), (F.col("illegal") + F.col("seams")).alias("illegal"))

    @F.pandas_udf("array<struct<seq: long, at: int, edit: string, role: string>>")
    def changes(seqs: pd.Series, codes: pd.Series, edits: pd.Series, entries: pd.Series) -> pd.Series:
        def of(seq, code, path, state):
            out, i, at = [], 0, 0
            for edit in path:
                if edit == "I":
                    state = _DUE[state]
                    out.append({"seq": seq[i], "at": at, "edit": edit, "role": ROLE[state]})
                    at += 1
                    continue
                if edit != "D":
                    state = _DUE[state] if edit == "R" else _after(state, code[i].lower())
                    out.append({"seq": seq[i], "at": at, "edit": edit, "role": ROLE[state] if edit == "R" else None})
                i, at = i + 1, 0
            return out

        return pd.Series([of(*r) for r in zip(seqs, codes, edits, entries, strict=True)], index=seqs.index)

    steps = taken.select("key", F.explode(changes("seqs", "code", "edits", "entry")).alias("c")).select("key", "c.*")
    texts = rows.select("seq", F.col("role").alias("_role"), "text")
    lines = steps.join(texts, "seq").select("key", "seq", "at", "edit", F.coalesce("role", "_role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    ends = taken.groupBy("key").agg(F.max(F.element_at("seqs", -1)).alias("seq")).join(whole, "key")
    late = F.when(F.col("ended") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("ended") == USER, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    added = ends.select("key", "seq", F.posexplode(late).alias("p", "role")).select("key", "seq", (F.col("p") + 1000).cast("int").alias("at"), F.lit("I").alias("edit"), "role", F.lit("").alias("text"))
    return verdicts, lines.unionByName(added)


def line_digests(lines: DataFrame) -> DataFrame:
    """(key, repaired_sha256): SHA-256 of a conversation's ``role:text`` lines. Lines are joined a few at a time first; then a conversation is one row."""
    body = F.struct("seq", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    joined = lambda name, field: F.array_join(F.transform(F.sort_array(F.col(name)), lambda r: r[field]), "\n")  # noqa: E731
    chunks = lines.groupBy("key", F.shiftright("seq", CHUNK_BITS).alias("chunk")).agg(F.collect_list(body).alias("b")).select("key", "chunk", joined("b", "line").alias("body"))
    return chunks.groupBy("key").agg(F.collect_list(F.struct("chunk", "body")).alias("c")).select("key", F.sha2(joined("c", "body").cast("binary"), 256).alias("repaired_sha256"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) to the report of each conversation and its repaired rows.

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit;
    the rows have conv_id, seq, at, edit, role and text, in the order of seq and at. All
    rows with a null conv_id are one conversation. Rows that share a turn are in the order
    of role and text. An empty table gives empty tables; other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = ordered(faults(conversations.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))))
    verdicts, lines = repaired(rows)
    counted = rows.groupBy("key").agg(
        *[_int(F.count_if(F.coalesce(F.col("fault") == f, F.lit(False)))).alias(f) for f in ("blank", "duplicate", "truncated")], F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("turns")
    )
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    back = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30).cast("long")).alias("conv_id")
    report = counted.join(verdicts, "key").select(back, gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, lines.select(back, "seq", "at", "edit", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes ``.!?`` out, 3 repeats, 4 makes it the user's; nulls count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    report, lines = repair(damaged(given))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    lined = line_digests(lines.withColumn("key", key))
    every = given.select("conv_id", key).distinct()
    out = every.join(report.withColumn("key", key).drop("conv_id"), "key", "left").join(lined, "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """Backward from the last row, each state carries its least (cost, edits) and the lines that they make."""
    least = lambda *options: f"list_min([{', '.join(options)}])"  # noqa: E731
    option = lambda cost, edit, line, rest: f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 'l': {line}{rest}.l}}"  # noqa: E731
    at, due, name = lambda src, s: f"{src}[{s + 1}]", (2, 2, 3, 2), ("", "system", "user", "assistant")  # noqa: E731
    states = range(4)

    def used(s: int) -> str:
        more = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
        keeps = [(2, "u"), (1, "s")] if s == 0 else [(due[s], name[due[s]][0])]
        arcs = [option("3", "D", "", at("st", s))]
        for to, initial in keeps:
            arcs.append(f"CASE WHEN initial = '{initial}' AND NOT gone THEN {option(more, 'K', '[role || chr(58) || text] || ', at('st', to))} END")
        arcs.append(f"CASE WHEN NOT gone THEN {option(f'2 + {more}', 'R', f'[{chr(39)}{name[due[s]]}:{chr(39)} || text] || ', at('st', due[s]))} END")
        return least(*arcs)

    insert = lambda src, s: least(at("e", s), option("2", "I", f"['{name[due[s]]}:'] || ", at(src, due[s])))  # noqa: E731
    ends = [(0, "", []), (4, "II", ["user:", "assistant:"]), (2, "I", ["assistant:"]), (0, "", [])]
    last = ", ".join(f"{{'c': {c}::BIGINT, 'a': '{a}', 'l': {lines}::VARCHAR[]}}" for c, a, lines in ends)
    return rf"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
given AS (SELECT *, coalesce('=' || conv_id, '') AS key, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
crc AS (SELECT key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 20 AS kind FROM given, bits),
dam AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE kind <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam),
said AS (SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS again FROM pos),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' END AS fault, role[1] AS initial,
  role[1] || lead(role[1]) OVER (PARTITION BY key ORDER BY pos) AS two FROM said),
rows_ AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone FROM faults),
dp AS (SELECT key, max(pos) + 1 AS pos, [{last}] AS st FROM rows_ GROUP BY 1
  UNION ALL SELECT key, pos, [{", ".join(insert("f", s) for s in states)}] FROM
  (SELECT key, pos, e, [{", ".join(insert("e", s) for s in states)}] AS f FROM
  (SELECT r.key, r.pos, [{", ".join(used(s) for s in states)}] AS e FROM dp JOIN rows_ r ON r.key = dp.key AND r.pos = dp.pos - 1))),
best AS (SELECT key, st[1] AS b FROM dp WHERE pos = 1),
counted AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM given) LEFT JOIN counted USING (key) LEFT JOIN best USING (key)
"""


OP12_SQL = _sql()
