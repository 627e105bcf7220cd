"""Filter audit, conversation repair, host rules, and samples that hold with repeated ids: against brute force, and odd rows."""

import hashlib
import heapq
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.llm import filter_audit, host_rules, joins, langid, learn, quality, repair, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 30000


def clash():
    return {k: F.lit(k) for k in ("part", "mask", "host", "m", "digest", "n", "key", "seq", "fault", "_place")}



def plain(n):
    return " ".join(f"word{i}" for i in range(n))


ODD = [
    (1, plain(60), "a"), (2, plain(60), "a"), (2, plain(60), "a"), (3, None, "a"), (4, "", "b"), (5, LONG, "b"), (6, " \n\t", None), (7, "SHOUT $ " * 40, None), (8, "a a a a", "c"),
    (9, plain(55) + "\nsame line\nsame line\n \nsame line", "c"), (None, plain(60), "a"), (None, plain(60), "a"), (None, None, None), (10, "中文 text " + plain(60) + "  x", "b"), (11, "x\x0by\x0cz\r\n" + plain(51), "c"), (12, plain(52) + " " + plain(3), "d"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, 0, 1), (8, 1, 0), (8, 1, 0), (9, None, 1), (77, 1, 1), (None, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns(clash()).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def brute_mask(text):
    words = WORD.findall(text)
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = [(brute_mask(t or "") | (i is not None and i > first[t or ""]) << 4, s or "", i in good, i in toxic) for i, t, s in rows]
    out = {}
    for part in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, stay = [d for d in left if d[0] & bit], [d for d in left if not d[0] & bit]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(1 for d in mine if d[0] & bit) - len(gone), sum(1 for d in mine if d[0] == bit), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
                left = stay
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = total[out[k][-1]]
    return out


def test_filter_audit_matches_brute_force(odd, labels):
    got = filter_audit.audit(filter_audit.document_masks(odd, labels), "ABCDE", ["good", "toxic"]).collect()
    want = brute_audit(ODD, LABELS)
    assert len(got) == len(want) == 600 * 5
    for r in got:
        assert want[r["part"], r["filter_order"], r["step"]] == [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert filter_audit.audit(filter_audit.document_masks(odd.where("doc_id < -9"), labels), "ABCDE", ["good", "toxic"]).count() == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 3, 4), ("p", 3, 1), ("q", 2, 7)], "part string, mask int, n long")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(rows, "XY", []).collect()}
    assert got["p", "XY", 1] == (5, 7, 0, 2, 9) and got["p", "XY", 2] == (5, 0, 5, 0, 5) and got["p", "YX", 1] == (7, 5, 0, 0, 5) and got["p", "YX", 2] == (5, 2, 5, 2, 9)
    assert got["q", "XY", 2] == (0, 7, 0, 7, 14)


def test_subset_sums_are_sums_over_subsets(spark):
    r = np.random.default_rng(1).integers(0, 100, 16).tolist()
    row = spark.range(1).select(F.array(*filter_audit.subset_sums([F.lit(int(v)) for v in r])).alias("s")).first()["s"]
    assert row == [sum(r[m] for m in range(16) if m & t == m) for t in range(16)]


def test_a_hot_key_is_dealt(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    facts = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    got = joins.dealt_left_join(rows, facts, ["k"], F.col("id"))
    assert got.count() == 2000 and got.where("v = 1").count() == 667 and got.where("v = 2").count() == 1 and got.columns == ["k", "id", "v"]


# --- host rules --------------------------------------------------------------------------------------------------
def brute_measure(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_measures_match_brute_force(odd):
    texts = [t for _, t, _ in ODD] + ["a b c a b c", "a a a", "a b a b a b", "<|x|> & *"]
    r = np.random.default_rng(2)
    texts += [" ".join(map(str, r.integers(0, 6, 40))) for _ in range(20)] + ["\n".join(map(str, r.integers(0, 4, 30))) for _ in range(5)]
    assert [host_rules.measure(t) for t in texts] == [brute_measure(t) for t in texts]
    got = host_rules.judge(odd).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got) == Counter((i, s, *brute_measure(t)) for i, t, s in ODD)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (not r["kept"] or not r["base_failed"]) for r in got)
    assert host_rules.judge(odd.where("doc_id < -9")).count() == 0


def test_many_distinct_words_take_the_other_way(monkeypatch):
    words = [b"w%d" % (i % 700_000) for i in range(1_400_000)]
    assert host_rules.repeated_words(words) == len(words)
    many = [b"%d" % i for i in range(1 << 20)] + [b"0", b"1", b"2"]
    assert host_rules.repeated_words(many) == 6


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = plain(60), "# | " * 30
    rows = [(i, f"{good} {i}", "fine") for i in range(300)] + [(1000 + i, f"{bad} {i}", "spam") for i in range(200)] + [(2000 + i, f"{good} {i}", "spam") for i in range(20)]
    rows += [(3000 + i, f"{good} n{i}", f"site{i % 40}") for i in range(400)] + [(5000, bad, "tiny")] + [(5001, f"{good} t", None)]
    got = {r["doc_id"]: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[2000 + i]["kept"] for i in range(20)) and all(got[2000 + i]["host_rejected"] for i in range(20))
    assert all(got[i]["kept"] for i in range(300)) and all(got[3000 + i]["kept"] for i in range(400)) and got[5001]["kept"]
    assert not got[5000]["host_rejected"] and not got[5000]["kept"]


def test_host_rates_by_hand(spark):
    rows = spark.createDataFrame([("a", i < 9) for i in range(10)] + [("b", False)] * 40 + [("c", True)] + [("d", i < 5) for i in range(50)], "host string, bad boolean")
    got = {r["host"]: r for r in host_rules.host_rates(rows, ["bad"]).collect()}
    f, n = np.array([9, 0, 1, 5.0]), np.array([10, 40, 1, 50.0])
    p = (f / n).mean()
    s = np.clip(p * (1 - p) / max((f / n).var(ddof=1) - p * (1 - p) * (1 / n).mean(), 1e-6) - 1, 1, 1e4)
    for k, h in enumerate("abcd"):
        assert np.isclose(got[h]["bad_rate"], (f[k] + s * p) / (n[k] + s))


# --- repair --------------------------------------------------------------------------------------------------------
COSTS = {"s": 0, "u": 1, "a": 2}


def brute_repair(rows):
    """Dijkstra over (row, roles so far as a state) with the path as part of the order: the least cost, then the least letters."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    seen, marks = set(), []
    for role, text in rows:
        if not WORD.search(text):
            marks.append("blank")
        elif (role, text) in seen:
            marks.append("duplicate")
        else:
            marks.append("truncated" if WORD.findall(text)[-1][-1] not in ".!?" else None)
        seen.add((role, text))
    # of one state only the least cost survives, but all least paths to it must; compare whole strings at the end
    best, heap, done = None, [(0, "", 0, "", ())], {}
    while heap:
        cost, path, i, state, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and state in ("", "a") and (best is None or (cost, path) < best[:2]):
            best = (cost, path, lines)
        if done.setdefault((i, state), cost) < cost or len(path) > 3 * len(rows) + 3:
            continue
        for role in ("user", "assistant"):
            if (state, role[0]) in legal:
                heapq.heappush(heap, (cost + 2, path + "I", i, legal[state, role[0]], (*lines, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, path + "D", i + 1, state, lines))
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                if (state, role[:1]) in legal:
                    heapq.heappush(heap, (cost + more, path + "K", i + 1, legal[state, role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in legal:
                        heapq.heappush(heap, (cost + 2 + more, path + "R", i + 1, legal[state, new[0]], (*lines, f"{new}:{text}")))
    return marks, best


def random_conversations(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for t in range(int(r.integers(0, 6))):
            out.append((c, None if r.random() < 0.1 else t, ["user", "assistant", "system", "tool", "", "user", "assistant"][r.integers(0, 7)], ["Hello.", "so", "Fine! ", " ", "", "a?", " ", "B.\n"][r.integers(0, 8)]))
    return out


@pytest.mark.parametrize("bits", [(10, 6), (1, 1)])
def test_repairs_are_cheapest_and_least(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "PIECE_BITS", bits[0])
    monkeypatch.setattr(repair, "CHUNK_BITS", bits[1])
    rows = random_conversations(3, 150) + [(None, 0, "user", "Hi."), (None, 1, "assistant", None), (None, 1, None, "Who?"), (500, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash())
    report, lines = repair.repair(table)
    got = {r["conv_id"]: r for r in report.collect()}
    texts = {}
    for r in sorted(lines.collect(), key=lambda r: (r["seq"], r["at"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role if role is not None else " ", text if text is not None else " ") for k, t, role, text in rows if k == c))
        marks, (cost, path, want) = brute_repair([m[2:] for m in mine])
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, path), (c, mine)
        assert texts.get(c, []) == list(want)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [marks.count(k) for k in ("blank", "duplicate", "truncated")]
        two = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        assert r["illegal"] == sum(t not in ("su", "ua", "au") for t in two)
        turns = [t for has, t, *_ in mine if has]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    none, nothing = repair.repair(table.where("conv_id < -5"))
    assert none.count() == 0 and nothing.count() == 0


def test_dial_distances_are_shortest_paths():
    r = np.random.default_rng(4)
    letters = repair.SOUND + repair.CUT_SHORT + repair.GONE
    for _ in range(200):
        code = "".join(r.choice(list(letters), int(r.integers(0, 9))))
        ends = tuple(int(v) for v in r.integers(0, 12, 4))
        want = [list(ends)]
        for letter in reversed(code):
            row = [min(cost + want[0][to] for _, cost, to in repair._arcs(letter)[s]) for s in range(4)]
            for _ in range(4):
                row = [min(row[s], repair.INSERT + row[repair._DUE[s]]) for s in range(4)]
            want.insert(0, row)
        assert repair.distances(code, ends) == want
        cost, edits, last = repair.walks(code, ends)
        for s in range(4):
            assert cost[s] == want[0][s] and len(edits[s].replace("I", "")) == len(code)


def test_a_long_conversation_is_cut_into_pieces(spark):
    n = 5000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 7 == 3, "user").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.when(F.col("id") % 11 == 0, "").otherwise(".")).alias("text"))
    report, lines = repair.repair(rows)
    r = report.first()
    code = "".join(("u" if i % 7 == 3 or i % 2 == 0 else "a").upper() if i % 11 == 0 else ("u" if i % 7 == 3 or i % 2 == 0 else "a") for i in range(n))
    cost, edits, last = repair.walks(code, repair.AT_END)
    assert r["cost"] == cost[0] and r["audit"] == edits[0] + repair.closing(last[0]) and lines.where("edit = 'I'").count() == r["audit"].count("I")


def test_damage_and_repair_as_sql_says(spark, tmp_path):
    rows = random_conversations(5, 300) + [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.") for c in range(1000, 1060) for t in range(6)] + [(None, 2, "user", "x"), (2000, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op12_repair(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(repair.OP12_SQL).df()
    assert len(got) == len(want) == len({r[0] for r in rows})
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype({"conv_id": "Int64"}).itertuples(index=False, name=None)))
    assert key(got) == key(want)
    dropped = next(c for c in range(10**6) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    spark.createDataFrame([(dropped, 0, "user", "gone.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "one" / "conversations.parquet"))
    row = repair.op12_repair(spark, str(tmp_path / "one")).first()
    assert row["audit"] == "" and row["cost"] == 0 and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# --- samples and repeated ids -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("ident", [7, 8, 9, None])
def test_samples_hold_with_one_id(spark, ident):
    rows = spark.range(20000).select(F.lit(ident).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    first, second = (sorted(r["text"] for r in learn.bounded_sample(learn.hashed(rows.repartition(k), ["doc_id", "text"], "s"), 3000, ["text"]).collect()) for k in (3, 7))
    assert first == second and len(first) == 3000 and len(set(first)) == 3000
    same = spark.range(5000).select(F.lit(ident).cast("long").alias("doc_id"), F.lit("one").alias("text"))
    assert learn.bounded_sample(learn.hashed(same, ["doc_id", "text"], "s"), 100, ["text"]).count() == 1
    assert learn.bounded_sample(learn.hashed(rows.limit(0), ["doc_id", "text"], "s"), 100, ["text"]).count() == 0


@pytest.mark.parametrize("ident", [7, None])
def test_languages_that_share_an_id_are_learned(spark, ident):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de') and length(text) > 100").select("doc_id", "text", "lang")
    one = docs.withColumn("doc_id", F.when(F.col("lang") == "en", F.col("doc_id")).otherwise(F.lit(ident)))
    model, again = langid.fit(one), langid.fit(one.unionByName(one).repartition(5))
    assert model.langs == ["de", "en"] and np.array_equal(model.w, again.w)
    got = langid.identify(docs.withColumns({"_lang": F.lit(1), "score": F.lit("old")}), one)
    assert got.columns == ["doc_id", "text", "lang", "_lang", "lang_pred", "score"]
    assert got.where("lang = lang_pred").count() > 0.98 * docs.count()
    few = langid.fit(one, per_lang=20, max_langs=1)
    assert len(few.langs) == 1


def test_a_labelled_id_on_many_rows_stays_bounded(spark, monkeypatch):
    sent = []
    whole = quality.Classifier
    monkeypatch.setattr(quality, "Classifier", lambda x, y: sent.append(len(x)) or whole(x, y))
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("Some words here, "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    quality.fit(docs, labels, labelled=150)
    quality.fit(docs, labels, labelled=10**6)
    assert sent[0] <= 150 and sent[1] == docs.join(labels, "doc_id").distinct().count()


def test_toxicity_with_one_id(spark):
    r = np.random.default_rng(6)
    bad, rest = [f"vile{k} scum filth" for k in range(60)], [" ".join(f"w{v}" for v in r.integers(0, 300, 20)) for _ in range(600)]
    rows = spark.createDataFrame([(1, f"{t} {rest[i]}") for i, t in enumerate(bad)] + [(2, t) for t in rest], "doc_id long, text string")
    rows = learn.hashed(rows, ["doc_id", "text"], "t")
    first, second = (toxicity.fit(rows.where("doc_id = 1").repartition(k), rows.repartition(k + 1), 0.09, positives=50, others=400) for k in (2, 5))
    assert np.array_equal(first.weights, second.weights) and len(first.at) > 0
    assert first.score("vile3 scum filth") > 0.5 > first.score(rest[0])


def test_chosen_features_stand_out_by_hand(spark):
    docs = spark.createDataFrame([(i, "toxicword common" if i < 40 else "common plain") for i in range(240)], "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" x"), F.col("doc_id").cast("string")))
    docs = learn.hashed(docs, ["doc_id", "text"], "t")
    model = toxicity.fit(docs.where("doc_id < 40"), docs, 1 / 6)
    kept = set(model.at)
    assert set(toxicity.word_features("toxicword")) <= kept and not set(toxicity.word_features("common")) & kept and not set(toxicity.word_features("plain")) & kept


@pytest.mark.parametrize("ident", [3, None])
def test_token_files_of_one_id_are_dealt(spark, tmp_path, ident):
    import public_tokenizers as P

    docs = spark.range(400).select(F.lit(ident).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    index = token_files.write_tokens(docs, P.path("word_bpe_49k.json"), str(tmp_path / "t"))
    assert max(p["docs"] for p in index["parts"]) < 300 and sum(p["docs"] for p in index["parts"]) == 400
    back = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").toPandas()
    assert (back["start"].diff().dropna().to_numpy() == back["n_tokens"].to_numpy()[:-1]).all() and back["doc_id"].isna().all() == (ident is None)
