import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stipple.llm import chat, components, embed_dedup, fingerprint, langid, learn, packing, quality, simhash, sp_sampling, store, token_files, toxicity
from stipple.llm.tokens import Encoder

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, "The cat  sat on\tthe mat."), (2, "the CAT sat on the mat."), (3, None), (4, ""), (5, LONG), (6, "ﬁn été"), (7, "FIN été"), (8, " \n\t"), (9, "中文 text ¡ñandú! <|endoftext|> </s>"), (9, "same id"), (None, "no id"), (None, "no id"), (12, "The cat  sat on\tthe mat.")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"fingerprint": F.lit("x"), "h": F.lit(1), "id": F.lit(2), "lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -5")


def brute_groups(fps, most):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints(spark, odd, none):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(ODD) and fingerprint.fingerprints(none).count() == 0
    by = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] not in (9, None)}
    assert by[1] == by[2] == by[12] and by[6] == by[7] and by[3] == by[4] == by[8] and len({*by.values()}) == 4
    assert edited_multiset(got, ODD) and {r["near_edited"] for r in got} <= {0.0, 1.0}


def edited_multiset(got, rows):
    """Whether the edited texts are those of some order of descending ids, whatever the order of ties."""
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    ids = sorted(texts, key=lambda i: (i is None, -(i or 0)))
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    for k, i in enumerate(ids):
        after = texts[ids[(k + 1) % len(ids)]] + texts[i]
        allowed = {sha(a, b) for a in texts[i] for b in after}
        mine = [r["edited_sha256"] for r in got if r["doc_id"] == i]
        if len(mine) != len(texts[i]) or not set(mine) <= allowed:
            return False
        # one row of each id leads to the next id, the others to rows of their own id
    return True


def test_next_documents_and_likenesses(spark):
    texts = ["Same text here now", "same  TEXT here now", "other words entirely", "aaa", "aaa", "", None, "x" * 5]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    canon = [" ".join((t or "").lower().split()) for t in texts]
    for k, (i, t) in enumerate(rows):
        a, b = t or "", texts[(k + 1) % len(texts)] or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(a)
        assert got[i]["near_next"] == float(canon[k] == canon[(k + 1) % len(texts)])
        assert got[i]["near_edited"] == float(" ".join(edited.lower().split()) == canon[k])
    assert {r["near_next"] for r in got.values()} == {r["near_edited"] for r in got.values()} == {0.0, 1.0}


def test_many_rows_of_one_id_and_of_none(spark):
    rows = [(i, f"text {i}") for i in range(60)] + [(30, f"again {i}") for i in range(200)] + [(None, f"none {i}") for i in range(150)] + [(7, "repeat me")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprint.in_ranges(df).where("doc_id = 30").select("r").distinct().count() > 5 and fingerprint.in_ranges(df).where("doc_id is null").select("r").distinct().count() > 3
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(rows) and edited_multiset(got, rows)
    # every text is the next one of exactly one row
    of = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for _, t in rows for _, u in rows}
    assert {r["edited_sha256"] for r in got} <= of


def test_equal_digests_of_unequal_texts_are_told_apart(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "A ", "b", "c", "b"])], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(rows, lambda c: F.lit("same")).collect()}
    assert got[0] == got[1] and got[2] == got[4] and len({*got.values()}) == 3


def test_ids_by_pieces_are_the_librarys():
    rng = np.random.default_rng(0)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "ß", "é", "é", "Σ", "中", "　", "\x1c", "\x85", "'s", "'", ".", "12", "_", "<|endoftext|>", "</w>", "\x00", "İ", "²", "d, ", "x\" ", "x.\nThe", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 20))) for _ in range(2000)] + ["a <|endoftext|> b", "A<|endoftext|>B", "word<|endoftext|>,\nword"]
    for name, mode, width in (("byte_bpe_50k.json", "byte", 4), ("word_bpe_49k.json", "word", 2)):
        whole = Tokenizer.from_file(P.path(name))
        e, plain = Encoder(P.path(name), mode, width), Encoder(P.path(name), mode, width, plain_controls=True)
        for t, x in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(e.encode(t), f"<u{width}").tolist() == x.ids
        control = whole.token_to_id("<|endoftext|>")
        assert control in np.frombuffer(e.encode("a <|endoftext|> b"), f"<u{width}") and control not in np.frombuffer(plain.encode("a <|endoftext|> b"), f"<u{width}")


def test_packing(spark, odd, none):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(odd.where("doc_id is not null and text <> 'same id' or text is null"), path).toPandas()
    assert packing.pack(none, path).count() == 0
    tok = Tokenizer.from_file(path)
    for doc, text in ODD:
        if doc is None or text == "same id":
            continue
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = rows[rows.doc_id == doc].sort_values("start")
        assert b"".join(mine.ids) == ids.tobytes() and (mine.doc_tokens == len(ids)).all() and (mine.start == mine.length.cumsum() - mine.length).all()
    full = rows.groupby("sequence_id").length.sum()
    assert (full <= 1024).all() and ((full & (full - 1)) == 0).all()
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()


def test_token_files(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    for df, n in ((odd, len(ODD)), (none, 0)):
        folder = store.fresh_path(spark, "t")
        token_files.write_tokens(df, path, folder)
        rows = token_files.read_tokens(spark, folder).toPandas().sort_values("start")
        assert len(rows) == n
        if not n:
            continue
        tok = Tokenizer.from_file(path)
        order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in order]
        assert [zlib.crc32(x.tobytes()) for x in ids] == [zlib.crc32(b) for b in rows.ids]
        assert rows.start.tolist() == [0, *np.cumsum([len(x) for x in ids])[:-1].tolist()]


def test_simhash_groups(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and simhash.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[12]["component_id"] == 1 and by[3]["fingerprint"] == "0" * 16 and by[8]["component_id"] == by[4]["component_id"] == 3
    assert int(by[5]["fingerprint"], 16) == int(simhash.simhash(LONG)[0])


@pytest.mark.parametrize("chunk", [5, 4096])
def test_simhash_links_match_brute_force(spark, chunk):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(6)} | {0, 15, 2**64 - 1})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "node long").withColumn("fp", F.array("node"))
    comp = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in components.components(simhash.link_edges(nodes, 1, 4, chunk)).collect()}
    label = brute_groups(fps, 4)
    mine = {}
    for f, x in zip(fps, label, strict=True):
        mine.setdefault(x, set()).add(comp.get(f, f))
    assert all(len(v) == 1 for v in mine.values()) and len({min(v) for v in mine.values()}) == len(mine)


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.one_of_each(odd)
    texts = sorted((r["text"] or "") for r in kept.select("text").collect())
    assert kept.columns == odd.columns and texts.count("no id") == 1 and sum(t.lower().startswith("the cat") for t in texts) == 1 and len(texts) == 8


def likeness(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_only_what_is_near_a_kept_document_goes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    line = words(12)
    texts = {1: " ".join(words(104) + line * 12), 2: " ".join(words(104) + line * 12)}
    old = words(200)
    for i in range(16):  # a chain: each is near the one before it, and far from the first soon
        texts[10 + i] = " ".join(old)
        old = old[7:] + words(7)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    want = []
    for i, t in texts.items():
        if not any(likeness(t, texts[k]) >= 0.8 for k in want):
            want.append(i)
    assert len(want) > 5
    for most in (simhash.IN_TURN, 6):
        monkeypatch.setattr(simhash, "IN_TURN", most)
        got = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
        assert got == want


def test_pairs_from_07_to_1_match_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = []
    for k in range(120):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        least = 0.69 + 0.31 * k / 119
        cut = round(300 * (1 - 2 * least / (1 + least)))
        b = [f"v{x}" for x in rng.integers(0, 10**6, cut)] + a[cut:]
        texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    like = [likeness(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    near = [i + 1 for i, v in zip(range(0, len(texts), 2), like, strict=True) if v >= 0.8]
    gone = set(range(len(texts))) - kept
    assert min(like) < 0.72 and len(near) > 60 and gone <= set(near) and len(gone) >= 0.95 * len(near)


def test_upper_nodes_do_not_depend_on_size():
    few, many = (simhash._upper_nodes(n, 5, 58, 2048) for n in (1000, 10**9))
    bits = [sum(m << 64 * k for k, m in enumerate(mask)) for mask in many]
    assert few == many and len(bits) == 26 and {b.bit_count() for b in bits} == {12} and sum(bits).bit_count() == 26 * 12


def test_wide_fingerprints_go_through_the_index(monkeypatch):
    r = np.random.default_rng(9)
    for n in (1, 2, 17, 300):
        x = r.integers(0, 2**64, (n, 5), dtype=np.uint64)
        x[:, 0] &= ~np.uint64(4095)
        for k in range(n // 3):
            x[n - 1 - k] = x[k] ^ (r.integers(0, 2**64, 5, dtype=np.uint64) & r.integers(0, 2**64, 5, dtype=np.uint64) & r.integers(0, 2**64, 5, dtype=np.uint64))
        for sparse in (1, 32, 10**9):
            monkeypatch.setattr(simhash, "SPARSE", sparse)
            one, other = (set(zip(*(p.tolist() for p in f(x, x, 68)), strict=True)) for f in (simhash.index_pairs, simhash.dense_pairs))
            assert one == other and len(one) >= n


def test_the_pipelines_links_come_from_the_index():
    import inspect

    assert "dense_pairs" not in inspect.getsource(simhash.link_edges) and "index_pairs" in inspect.getsource(simhash.link_edges)


def test_dense_pairs_are_those_of_the_index():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, (300, 5), dtype=np.uint64)
    x[100:] = x[rng.integers(0, 100, 200)] ^ (np.uint64(1) << rng.integers(0, 63, (200, 5), dtype=np.uint64))
    pairs = [set(zip(*(p.tolist() for p in f(x[:150], x, 8)), strict=True)) for f in (simhash.index_pairs, simhash.dense_pairs)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 150


def test_index_drops_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    x[150:] = x[:150] ^ (np.uint64(1) << rng.integers(0, 63, (150, 2), dtype=np.uint64))
    a, b = simhash.index_pairs(x, x, 40)
    want = np.bitwise_count(x[:, None] ^ x[None]).sum(-1) <= 40
    got = np.zeros_like(want)
    got[a, b] = True
    assert (got == want).all() and len(a) == want.sum()


def test_chat_round_trip_and_branches(spark):
    rows = [("t", 1, None, "user", "hi [x] <|im_end|>\n \\e \\", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "</s>good\n", 0.9), ("t", 4, 3, "us\ner", None, 0.0), ("o", 9, 77, None, "orphan", None), ("c", 1, 2, "user", "ring", 1.0), ("c", 2, 1, "user", "ring", 1.0), ("c", 3, 2, "user", "under it", 1.0)]
    m = spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double")
    got = {r["tree"]: r for r in chat.read_back(chat.format_trees(m)).collect()}
    assert set(got) == {"t", "o"} and got["t"]["leaf"] == 4
    assert [tuple(t) for t in got["t"]["turns"]] == [("user", rows[0][4]), ("assistant", "</s>good\n"), ("us\ner", "")]
    assert got["t"]["loss_text"] == "</s>good\n" and "</s>" not in got["t"]["formatted"]
    assert chat.format_trees(m, top=5).where("tree = 't'").count() == 2
    assert chat.format_trees(m.where("msg < 0")).count() == 0


def test_conversations_keep_ties_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", None), (None, 3, None, "x"), (None, None, "assistant", "y")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat.read_back(chat.format_trees(chat.conversation_messages(c))).collect()}
    assert [t["text"] for t in got["1"]["turns"]] == ["", "a", "a"] and [t["text"] for t in got[""]["turns"]] == ["y", "x"]


def test_long_chain_is_one_path(spark):
    m = spark.range(1, 70).select(F.lit("t").alias("tree"), F.col("id").alias("msg"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    turns = chat.read_back(chat.format_trees(m)).first()["turns"]
    assert [t["text"] for t in turns] == [str(i) for i in range(1, 70)]


def test_heads_of_groups_are_their_first_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), bool(n), int(i), int(h)) for c, n, i, h in zip(rng.choice([1, 1, 1, 2, 3], 3000), rng.random(3000) < 0.1, rng.integers(500, size=3000), rng.integers(10**9, size=3000), strict=True)]
    df = spark.createDataFrame(rows, "component long, none boolean, id long, text_hash long")
    for block in (7, 4096):
        want = [r for c in (1, 2, 3) for r in sorted(x for x in rows if x[0] == c)[:block]]
        assert sorted(map(tuple, simhash._heads(df, block).collect())) == want


def brute_links(x, least=0.95):
    """Links by cosine in double precision among finite non-zero vectors of one length."""
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for v, g in zip(x, good, strict=True)]
    link = np.zeros((len(x), len(x)), bool)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b):
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= least
    return link


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = [(base[i % 40] + rng.normal(size=16) * 0.12 * (i % 4)).tolist() for i in range(300)] + [(3.0 * base[0]).tolist()] * 3
    x += [[0.0] * 16, None, [], [1.0], [-2.0], [3.0], [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0], [1.0, 0.01]]
    x += [[1e200, 1e200], [1e200, 1.01e200], [1e-200, 1e-200], [1e-200, 1.01e-200], [5e-324, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "n_links": F.lit("x")})
    link = brute_links(x)
    comp = simhash.local_stars(len(x), *np.nonzero(link))
    for tile in (32, None):
        got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, tile=tile).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == comp.tolist() and all(got[i]["kept"] == (comp[i] == i) for i in got)
    assert embed_dedup.near_vectors(df.where("vec_id < 0")).count() == 0


def test_vectors_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (None, None), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embed_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True), (9, 0, 9, True)], key=str)


def test_vectors_match_their_sql(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    x = [np.float32(base[i % 20] + rng.normal(size=8) * 0.12 * (i % 4)).tolist() for i in range(120)]
    x += [[0.0] * 8, None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [2.0], [-1.0], [1.0, 0.0], [1.0, 0.01]]
    rows = pd.DataFrame({"vec_id": range(len(x)), "embedding": x})
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", list(rows.itertuples(index=False, name=None)))
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embed_dedup.OP8_SQL}) ORDER BY 1").fetchall()
    got = embed_dedup.near_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert list(map(tuple, got)) == want and sum(n > 0 for _, n, _, _ in want) > 30


def test_blocks_of_a_tile_hold_all_links(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    for dim in (8, 2500):
        base = rng.normal(size=(30, dim))
        x = np.vstack([base + rng.normal(size=base.shape) * 0.2 for _ in range(4)])
        order = np.argsort(np.tile(np.arange(30), 4), kind="stable")
        x, y = x[order][:70], x[order][50:]
        for other in (None, y):
            a, b = embed_dedup.tile_links(x, other, 0.95)
            u, v = x / np.linalg.norm(x, axis=1, keepdims=True), (x if other is None else other) / np.linalg.norm(x if other is None else other, axis=1, keepdims=True)
            want = u @ v.T >= 0.95
            if other is None:
                want = np.triu(want, 1)
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(want)), strict=True)) and want.any()


def test_quantised_bound_holds():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(50, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = embed_dedup.quantise(u)
    low = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s
    assert (u @ u.T <= low + e[:, None] * (1 + e) + e + 1e-12).all()


def sentences(lang, n, rng):
    words = {"en": "the and of that with from this have house water", "nl": "de het een van dat niet zijn huis water maar", "es": "el la los que una por casa agua pero como", "it": "il lo gli che una per casa acqua ma come"}[lang].split()
    return [" ".join(rng.choice(words, 30)) for _ in range(n)]


def test_language(spark, odd, none):
    rng = np.random.default_rng(0)
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in ("en", "nl", "es", "it") for t in sentences(lang, 60, rng))]
    docs = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 !?", "en"), (1002, "x y", None)], "doc_id long, text string, lang string")
    train = docs.where(learn.fold("doc_id", 4) != 2)
    got = {r["doc_id"]: r for r in langid.identify(docs, train).collect()}
    held = [i for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.9
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and 0 <= got[1002]["score"] <= 1
    assert len(langid.identify(odd, train).collect()) == len(ODD) and langid.identify(none, train).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, train.where("doc_id < 0")).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(0)
    vocab = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [(i, " ".join(rng.choice(vocab, 60)) + (" vileness grumpkin" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0] + [(9000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels, learn.fold("doc_id", 5) == 0).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert np.mean([got[i]["predicted"] == y for i, _, y in held]) > 0.97 and 0 <= got[9000]["score"] <= 1 and len(got) == 802
    assert len(toxicity.score_documents(odd, labels.where("doc_id < 0"), F.lit(False)).collect()) == len(ODD) and toxicity.score_documents(none, labels, F.lit(False)).count() == 0


def test_toxic_copies_hide_no_toxic_words(spark):
    rng = np.random.default_rng(1)
    vocab = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    copy = " ".join(rng.choice(vocab, 60)) + " vileness grumpkin"
    rows = [(i, copy, 1) if i % 3 == 0 else (i, " ".join(rng.choice(vocab, 60)) + (" vileness grumpkin" if i % 8 == 1 else ""), int(i % 8 == 1)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i // 24 % 2 == 0], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels, learn.fold("doc_id", 5) == 0).collect()}
    for y in (0, 1):
        assert np.mean([got[i]["predicted"] == y for i, t, k in rows if k == y and t != copy]) > 0.95
    assert all(got[i]["predicted"] == 1 for i, t, _ in rows if t == copy)


def test_quality(spark, odd, none):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 50)) if i % 5 else "Spam!! " * 40, "en", f"h{i % 7}", int(i % 5 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").withColumn("keep", F.lit("old"))
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3 == 0], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.assess(docs, labels).collect()}
    assert all(got[r[0]]["keep"] == bool(r[4]) for r in rows)
    assert len(quality.assess(odd, labels).collect()) == len(ODD) and quality.assess(none, labels).count() == 0
    assert all(r["keep"] for r in quality.assess(docs, labels.where("doc_id < 0")).collect())


def test_sparse_sites_shrink(spark):
    soft = spark.createDataFrame([("a", "x", 0.9)] * 50 + [("a", "y", 0.1)] + [("b", "z", 0.1)] * 50, "_host string, _path string, _p double")
    got = {(r["_host"], r["_path"]): r for r in quality.site_posteriors(soft).collect()}
    assert got["a", "y"]["path_mean"] > 0.3 and got["a", "x"]["path_mean"] > 0.8 and got["b", "z"]["path_mean"] < 0.2


def every_segmentation(c, unit):
    if not unit:
        return [((), 0.0)]
    out = [((k, *rest), c.logw[k] + w) for j in range(1, min(len(unit), c.longest) + 1) if (k := c.piece.get(unit[:j])) is not None for rest, w in every_segmentation(c, unit[j:])]
    if unit[0] not in c.piece:
        ids = c.chars[-c._char(unit[0]) - 1]
        out += [((*ids, *rest), c.byte_logw * len(ids) + w) for rest, w in every_segmentation(c, unit[1:])]
    return out


def test_sampling_without_replacement_has_the_right_chances():
    c = sp_sampling.Codec(P.path("piece_bpe_32k.model"))
    segs = every_segmentation(c, c.sp.normalize("the ab"))
    w = np.exp([x for _, x in segs])
    chance = {s: p / w.sum() for (s, _), p in zip(segs, w, strict=True)}
    first, pairs_, n = {}, {}, 3000
    for seed in range(n):
        got = c.sample("the ab", seed, 3)
        ids = [tuple(x["ids"].tolist()) for x in got]
        assert len(set(ids)) == 3 and all(np.isclose(np.exp(x["log_prob"]), chance[i]) for x, i in zip(got, ids, strict=True))
        assert got[0]["key"] >= got[1]["key"] >= got[2]["key"]
        first[ids[0]] = first.get(ids[0], 0) + 1
        pairs_[tuple(ids[:2])] = pairs_.get(tuple(ids[:2]), 0) + 1
    for s, k in first.items():
        assert abs(k / n - chance[s]) < 0.03
    for (a, b), k in pairs_.items():
        assert abs(k / n - chance[a] * chance[b] / (1 - chance[a])) < 0.03
    assert len(c.sample("a", 1, 9)) == 2 and {x["log_inclusion"] for x in c.sample("a", 1, 9)} == {0.0}


def test_sampled_and_own_segmentations_decode(spark, odd, none):
    path = P.path("piece_bpe_32k.model")
    got = sp_sampling.sample_segmentations(odd, path, 2).collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got} == {d for d, _ in ODD}
    again = sp_sampling.sample_segmentations(odd, path, 2).collect()
    key = lambda r: (r["doc_id"] or -1, r["sample"], bytes(r["ids"]))
    assert sorted(map(key, got)) == sorted(map(key, again)) and sp_sampling.sample_segmentations(none, path).count() == 0
    both = odd.select("text", sp_sampling.decode_column(sp_sampling.encode_column(F.col("text"), path), path).alias("back"))
    assert all((r["text"] or "") == r["back"] for r in both.collect())


def scalar_simhash(text, words=4):
    """The fingerprint bit by bit, from the definition."""
    import re

    import xxhash

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([" ".join(tokens)] if tokens else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_bits_follow_the_definition(spark, odd):
    got = {(r["id"], r["text_hash"]): int(r["fp"][0]) % (1 << 64) for r in simhash.with_fingerprint(odd).collect()}
    texts = {(r["doc_id"], r["h"]): r["text"] for r in odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    assert got == {k: scalar_simhash(t) for k, t in texts.items()}


def test_quality_posteriors_follow_from_evidence(spark):
    """The posteriors again from the evidence alone, by loops."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, 40)) if i % 4 else "Buy!! $$$ NOW " * 9, f"h{i % 5 if i % 3 else 0}", "ab"[i % 7 == 0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    e = dict(zip([r[0] for r in rows], model.evidence([r[1] for r in rows]), strict=True))
    prior = np.log(model.base / (1 - model.base))
    p = {i: 1 / (1 + np.exp(-(x + prior))) for i, x in e.items()}
    sites = {}
    for i, _, host, path in rows:
        sites.setdefault((host, path), []).append(p[i])
    hosts = {}
    for (host, _), v in sites.items():
        hosts.setdefault(host, []).extend(v)
    top, total = np.mean(list(p.values())), len(rows)
    noise = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in sites.values()) / (total - len(sites))

    def strength(groups):  # (n, mean, parent's mean)
        g = [x for x in groups if x[0] >= 2]
        n = sum(x[0] for x in g)
        spread = (sum(k * (m - q) ** 2 for k, m, q in g) - len(g) * noise) / max(n - sum(x[0] ** 2 for x in g) / n, 1.0)
        return float(np.clip(np.mean([q * (1 - q) for *_, q in g]) / max(spread, 1e-6) - 1, 1.0, 1e4))

    outer = strength([(len(v), np.mean(v), top) for v in hosts.values()])
    host_mean = {h: (sum(v) + outer * top) / (len(v) + outer) for h, v in hosts.items()}
    inner = strength([(len(v), np.mean(v), host_mean[h]) for (h, _), v in sites.items()])
    got = {r["doc_id"]: r for r in quality.assess(docs, labels).collect()}
    for i, _, h, path in rows:
        v = sites[h, path]
        others = np.clip((sum(v) - p[i] + inner * host_mean[h]) / (len(v) - 1 + inner), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-(e[i] + np.log(others / (1 - others)))))
        assert np.isclose(got[i]["posterior"], want, rtol=1e-6) and np.isclose(got[i]["host_mean"], host_mean[h], rtol=1e-9) and got[i]["keep"] == (want >= 0.5)


def test_quality_of_held_out_documents():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 50)) if i % 3 else " ".join(rng.choice(["BUY", "now!!", "$$$", "click"], 40)) for i in range(400)]
    y = np.array([float(i % 3 > 0) for i in range(400)])
    model = quality.Classifier(np.array([quality.features(t) for t in texts[:200]]), y[:200])
    assert ((model.evidence(texts[200:]) > 0) == (y[200:] > 0)).mean() > 0.97


def test_positive_unlabelled_risk_is_the_estimators():
    """A scalar version of the corrected risk: descent ends where the risk is hardly lower nearby."""
    rng = np.random.default_rng(4)
    pos, neg = rng.binomial(1, 0.7, (150, 4)), rng.binomial(1, 0.2, (350, 4))
    unl = np.vstack([rng.binomial(1, 0.7, (88, 4)), neg]).astype(np.float32)
    pos = pos.astype(np.float32)

    def risk(w, prior=0.2, ridge=1e-4):
        loss = lambda z: float(np.log1p(np.exp(-z)))
        score = lambda row: float(sum(a * b for a, b in zip(row, w[:-1], strict=True)) + w[-1])
        p_up = sum(loss(score(r)) for r in pos) / len(pos)
        p_down = sum(loss(-score(r)) for r in pos) / len(pos)
        u_down = sum(loss(-score(r)) for r in unl) / len(unl)
        return prior * p_up + max(0.0, u_down - prior * p_down) + ridge / 2 * sum(x * x for x in w[:-1])

    w = learn.non_negative_pu(pos, unl, 0.2, steps=1500)
    here = risk(w)
    assert here < risk(np.zeros(5)) and all(risk(w + d) > here - 1e-3 for d in 0.3 * np.vstack([np.eye(5), -np.eye(5)]))


def test_language_votes_match_a_scalar_version():
    rng = np.random.default_rng(5)
    texts = [(lang, t) for lang in ("en", "nl", "es", "it") for t in sentences(lang, 40, rng)]
    x = np.array([langid.features(t) for _, t in texts])
    model = langid.Model(x, np.array([lang for lang, _ in texts]))
    for _, text in texts[::9]:
        counts = {}
        raw = langid._bytes(text)
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                b = raw[i : i + n]
                h = b[0] * 0xC2B2AE35 if n == 1 else b[0] * 0x9E3779B1 + b[1] * 0x85EBCA6B if n == 2 else (b[0] * 0x9E3779B1 + b[1] * 0x85EBCA6B) * 0x27D4EB2F + b[2] * 0x165667B1
                counts[h % 2**32 >> 20] = counts.get(h % 2**32 >> 20, 0) + 1
        size = sum(counts.values()) ** 0.5
        z = [sum(model.w[k, f] * c**0.5 / size for f, c in counts.items()) + model.w[k, -1] for k in range(len(model.w))]
        prob = [1 / (1 + np.exp(-(a * v + b))) for v, (a, b) in zip(z, model.scale, strict=True)]
        family = max(range(len(model.families)), key=lambda f: prob[model.first[f]])
        votes = {k: 0.0 for k in model.families[family]}
        for (i, j), m in model.pairs.items():
            if i in votes:
                votes[i if prob[m] >= 0.5 else j] += 1 + abs(prob[m] - 0.5) / 100
        assert model.predict(text)[0] == model.langs[max(sorted(votes), key=votes.get)]


def test_chat_of_empty_and_long_tables(spark):
    c = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", "[" * 5000)], "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    r = chat.read_back(chat.format_trees(chat.conversation_messages(c))).first()
    assert [t["text"] for t in r["turns"]] == [LONG, "[" * 5000] and r["loss_text"] == "[" * 5000
    assert chat.format_trees(chat.conversation_messages(c.where("conv_id < 0"))).count() == 0


def test_a_spine_with_a_leaf_at_each_step(spark):
    rows = [("t", i, i - 1 if i else None, 0.0) for i in range(40)] + [("t", 100 + i, i, float(i == 17)) for i in range(40)]
    m = spark.createDataFrame(rows, "tree string, msg long, parent long, score double").withColumns({"role": F.lit("user"), "text": F.col("msg").cast("string")})
    r = chat.read_back(chat.format_trees(m)).first()
    assert r["leaf"] == 117 and [t["text"] for t in r["turns"]] == [str(i) for i in range(18)] + ["117"] and abs(r["path_score"] - 1 / 19) < 1e-12


def test_samples_do_not_depend_on_the_block_and_shared_beginnings_are_looked_up_once():
    c = sp_sampling.Codec(P.path("piece_bpe_32k.model"))
    texts = ["", "a", "the quick brown fox", "naïve 中文 \U0001f600 café", "x" * 300, "the quick  brown\nfox 12345"]
    alone = [c.sample(t, seed, 4) for seed, t in enumerate(texts)]
    together = sp_sampling.Codec(P.path("piece_bpe_32k.model")).sample_block(texts, list(range(len(texts))), 4)
    flat = lambda rows: [[(x["ids"].tolist(), x["log_prob"], x["key"], x["log_inclusion"]) for x in r] for r in rows]
    assert flat(alone) == flat(together)
    search = sp_sampling._Search(c, c.units(texts[2]), 3)
    for _ in range(3):
        node, unit = search.start()
        u, e = c._walk(node, unit, sp_sampling._mix(unit.astype(np.uint64)))
        search.finish(u, e)
    assert all(np.array_equal(p, c.edge[3][e]) for p, (_, e) in zip(search.logs, search.paths, strict=True))
    # every move of the trie is found, and no other
    moves = c.step[c.step >= 0]
    assert len(moves) and np.array_equal(c._found(moves), c.then[c.step >= 0]) and (c._found(np.setdiff1d(moves + 1, moves)) == -1).all()
