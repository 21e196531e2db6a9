"""Language, mixing, packed ids, URL filters, decontamination and the pipeline."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plumbgrid.llm import decontaminate, language, mixing, packing, queries, urls
from plumbgrid.llm.text import Powers, slices, spans, word_hashes
from plumbgrid.session import scratch_path
from pyspark.sql import functions as F
from samples import CLASHING, SCHEMA, sentence


def test_word_hashes_follow_the_words():
    texts = pa.array(["a b  c", "", None, "  x\n", "b", "a\tb", "é ", "tail", "tail x"])
    hashes, offsets = word_hashes(texts, Powers())
    words = [w for t in texts.to_pylist() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert offsets.tolist() == [0, 3, 3, 3, 4, 5, 7, 8, 9, 11]
    values = np.arange(20, dtype=np.uint64) % np.uint64(4)
    named = spans(values, np.array([0, 4, 8, 1]), np.array([3, 7, 11, 4]), Powers())
    assert named[0] == named[1] == named[2] != named[3]
    assert list(slices(pa.array(["a" * 10] * 5 + ["b" * 99]), 20)) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        codes = language.codewords(n)
        assert set(np.unique(codes)) <= {-1.0, 1.0} and (np.abs(codes.sum(axis=0)) < n).all()
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= codes.shape[1] / 4


def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "123 !!", None), (9004, "x", None),
                                 (None, "the of and", "xx")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("other"))
    model = language.train(both.where(language.learnable()))
    assert model.languages == ["de", "en", "es", "fr"]
    got = language.predict(both, model).join(both.select("doc_id", "lang", language.held_out().alias("held")), "doc_id").collect()
    held = [r for r in got if r.held and r.doc_id < 9000]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3 and by[9001].score == 0
    assert all(0 <= r.score <= 1 for r in got) and by[9004].lang_pred != "und"
    nothing = language.train(empty)
    assert nothing.languages == [] and language.predict(docs.limit(2), nothing).first().lang_pred == "und"
    one = language.train(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language.predict(docs.limit(5), one).collect()} == {"de"}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


@pytest.mark.parametrize("targets", [dict(entropy=0.95), dict(repeats=1.5, budget=6000.0), dict(entropy=0.9, cover=True),
                                     dict(entropy=2.0), dict()])
def test_mixing(spark, targets):
    sizes = {"a": 300, "b": 60, "c": 20, None: 5}
    rows = [(i * 10 + k, f"{s} w{i} " + "x " * (i % 7), "en", s, 0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(-1, None, "en", "a", 0), (-2, " ", "en", "d", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    tokens = {s: sum(len(r[1].split()) for r in rows if r[3] == s and r[1]) for s in sizes}
    plans = {r.source: r for r in mixing.plan(mixing.sized(docs).select("source", "tokens"), targets.get("entropy"),
                                              targets.get("repeats"), targets.get("budget"), targets.get("cover", False)).collect()}
    assert {s: r.tokens for s, r in plans.items()} == tokens
    total = sum(tokens.values())
    x = next(iter(plans.values())).exponent

    def weights(exponent):
        powered = {s: (t / total) ** exponent for s, t in tokens.items()}
        return {s: p / sum(powered.values()) for s, p in powered.items()}

    assert all(plans[s].weight == pytest.approx(w) for s, w in weights(x).items())
    most = entropy([1 / 4] * 4)
    if targets.get("entropy", 9) <= 1:
        assert entropy(weights(x).values()) >= targets["entropy"] * most - 1e-9
        assert entropy(weights(min(1, x + 1e-6)).values()) <= targets["entropy"] * most
    elif "entropy" in targets:
        assert x == 0
    elif "repeats" in targets:
        over = [max(w * 6000 / tokens[s] for s, w in weights(e).items()) for e in (x, x - 1e-6)]
        assert over[0] <= 1.5 + 1e-9 and (over[1] > 1.5 or x == 0) or x == 1
    got = mixing.mixed(docs.withColumn("_block", F.lit(1)), **targets).collect()
    taken = {s: sum(r._tokens for r in got if r.source == s) for s in sizes}
    longest = 9
    for s, r in plans.items():
        assert r.wanted - longest <= taken[s] <= r.wanted
        counts = {}
        for row in got:
            if row.source == s:
                counts[row.doc_id] = counts.get(row.doc_id, 0) + 1
        times = set(counts.values())
        assert max(times) - min(times) <= 1 and max(times) <= math.ceil(r.wanted / r.tokens)
    if targets.get("cover"):
        assert {r.doc_id for r in got} == {r[0] for r in rows if r[0] >= 0}
    again = mixing.mixed(docs.repartition(2), **targets).select("doc_id", "_epoch", "_order").collect()
    assert sorted((r.doc_id, r._epoch, r._order) for r in got) == sorted(map(tuple, again))


@pytest.mark.parametrize("sizes", [[6000] + [600] * 18 + [12], [3000, *[600] * 9, 45, 90, 180, 270]])
def test_cover_keeps_the_limit_to_repeats(spark, sizes):
    """A hot source and tiny ones: the budget that takes all of the hot one does not repeat them more."""
    rows = [(s * 10_000 + i, "a b c", "en", f"s{s}", 5) for s, n in enumerate(sizes) for i in range(n // 3)]
    targets = dict(entropy=queries.MIX_ENTROPY, repeats=queries.MIX_REPEATS, cover=True)
    table = spark.createDataFrame([(f"s{s}", n) for s, n in enumerate(sizes)], "source string, tokens long")
    plans = mixing.plan(table, targets["entropy"], targets["repeats"], None, True).collect()
    times = [r.weight / r.tokens for r in plans]
    assert max(times) / min(times) == pytest.approx(queries.MIX_REPEATS) and 0 < plans[0].exponent < 1
    assert all(r.tokens <= r.wanted <= queries.MIX_REPEATS * r.tokens for r in plans)
    counts = [r["count"] for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA), **targets).groupBy("doc_id").count().collect()]
    assert len(counts) == len(rows) and max(counts) == queries.MIX_REPEATS


def test_mixing_of_nothing(empty):
    assert mixing.mixed(empty, entropy=0.9, repeats=2.0).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for width in (1, 5, 16, 17, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 1 << width, n).astype(np.uint32)
            payload = packing.pack(ids, width)
            assert len(payload) == -(-n // 64) * width * 8
            assert (packing.unpack(payload, width, 0, n) == ids).all()
            assert (packing.unpack(payload, width, n // 3, n - n // 4) == ids[n // 3:n - n // 4]).all()
    assert [packing.width_of(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name, rows):
    from tokenizers import Tokenizer
    file = queries.tokenizer_file(name)
    plain, own = Tokenizer.from_file(file), packing.Encoder(file)
    texts = [t for _, t, *_ in rows] + ["it's Don'T a\x1cb ́x é A B 12345", "<|endoftext|> x<|endoftext|>y", "ﬁ İI ΣΑΣ",
                                        "x's 's. a'll can't!", "한국어, 日本。語 가", "a b\u2028c  !!! ..."]
    for part in (texts, texts[::-1]):
        for t, ids in zip(part, own(part)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids
    assert own.by_pieces == (name == "word_bpe_49k.json")


def test_packed_documents(spark, docs, rows, empty):
    from tokenizers import Tokenizer
    file = queries.tokenizer_file()
    plain = Tokenizer.from_file(file)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, stream = [], []
    for d, t, *_ in order:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream += ids
    path = scratch_path(spark, "test-ids")
    packing.write(docs, path, file, 2, block_ids=500)
    got = sorted((tuple(r) for r in packing.documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()),
                 key=lambda r: r[1])
    assert got == want
    for first, last in ((0, len(stream)), (700, 1900), (len(stream) - 3, len(stream) + 9), (5, 5)):
        assert packing.ids_between(spark, path, first, last).tolist() == stream[first:last]
    assert packing.encoded(empty, file, 2).count() == 0


def test_urls(spark):
    urls_in = ["http://A.example.NET/en/1?x=1", "https://example.net/fr/2", "ftp://b.example.com/de/3", "http://x.org/fr/",
               "http://x.org", "http://x.net", "no scheme", None, "", "http://net/", "http://notnet/", "a://b://c/d?e#f",
               "http://EXAMPLE.com/DE/1", "http://x.example.com/de", "http://?q", "http://ex.org/fr/a://net/"]
    rows = [(i, u, "x") for i, u in enumerate(urls_in)] + [(0, urls_in[0], "y")]
    rows += [(1000 + i, f"http://spam{i % 3}.example.net/de/{i}?utm={i}", "z") for i in range(60)]
    rows += [(2000 + i, f"http://good.x{i}.org/fr/{i}", "z") for i in range(60)]
    rows += [(3000, "http://q.example/x?utm=5", "z"), (3001, "http://good.other/y", "z"), (3002, "http://new.one/", "z")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)

    def parsed(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]

    given = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    url = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = parsed(url[r.page_id])
        fits = [g for g in given if (host == g.split("/")[0] or host.endswith("." + g.split("/")[0]))
                and path.startswith(g[g.index("/"):])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == given[rule]
    by = {r.page_id: r for r in got}
    assert by[3000].verdict == "block" and by[3001].verdict == "allow" and by[3002].tokens_matched is None
    none = urls.judge(spark.createDataFrame([], "page_id long, url string"))
    assert none.count() == 0


def test_mined_rules_are_those_of_the_counts(spark):
    import random
    from itertools import combinations
    rng = random.Random(4)
    rows = [(rng.sample("abcdef", rng.randrange(1, 5)), rng.choice(("block", "allow", "allow"))) for _ in range(200)]
    rows += [(["a", "z"], "block")] * 30
    # Four tokens together say what no three do, and two stand in the same rows.
    for left_out in ("", *"abcd"):
        rows += [([t for t in "abcd" if t != left_out] + ["f", "g"], "allow" if left_out else "block")] * 25
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.n) for r in urls.mine(
        spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.6).collect()}
    sure = {}
    for size in range(1, 9):
        for tokens in combinations("abcdefgz", size):
            held = [v for t, v in rows if set(tokens) <= set(t)]
            for verdict in ("block", "allow"):
                n = held.count(verdict)
                if n >= int(0.05 * len(rows)) and n / len(held) >= 0.6:
                    sure[tokens, verdict] = (n / len(held), len(held))
    want = {k: v for k, v in sure.items() if not any(
        sure.get((tuple(t for t in k[0] if t != x), k[1]), (0,))[0] >= v[0] for x in k[0])}
    assert got == {k: (pytest.approx(c), n) for k, (c, n) in want.items()} and got
    assert any(len(tokens) >= 4 for tokens, _ in got) and any("g" in tokens for tokens, _ in got)


def test_long_urls_are_mined_in_time(spark):
    """Forty path pieces, alone, in copies and in both verdicts: no list of their subsets."""
    pieces = [f"p:{i}" for i in range(40)]
    rows = [(pieces, "block")] + [([*pieces, "h:x"], "allow")] * 20 + [([*pieces, "h:y"], "block")] * 20 + [(["h:z"], "allow")] * 30
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()
    assert {(tuple(r.tokens), r.verdict) for r in got} == {(("h:x",), "allow"), (("h:y",), "block"), (("h:z",), "allow")}
    wide = [(f"http://a.other/{'/'.join(f'w{i}' for i in range(40))}?x", "http://spam.net/" + "/".join(f"v{i}" for i in range(40)))[k % 2] for k in range(60)]
    pages = spark.createDataFrame([(None if k == 5 else k, u) for k, u in enumerate(wide)], "page_id long, url string")
    assert sorted(r.verdict for r in urls.judge(pages).collect()) == ["allow"] * 30 + ["block"] * 30


def test_common_subsequence():
    import random
    rng = random.Random(6)
    for _ in range(60):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == table[-1][-1]


def test_leaks(spark, docs, empty):
    import random
    rng = random.Random(8)
    items = [(i, ". ".join(sentence(rng, 9 + i % 5) for _ in range(3))) for i in range(30)] + [(90, None), (91, " "), (None, "x y z")]
    rows = [(500 + i, sentence(rng, rng.randrange(5, 200))) for i in range(60)]
    for i in range(20):
        words = items[i][1].split()
        if i % 4 == 1:  # some words replaced
            for at in rng.sample(range(len(words)), len(words) // 8):
                words[at] = "other"
        if i % 4 == 2:  # some left out
            words = [w for j, w in enumerate(words) if j % 9 != 4]
        around = sentence(rng, rng.randrange(0, 150)), sentence(rng, rng.randrange(0, 150))
        rows.append((600 + i, f"{around[0]} {' '.join(words).upper() if i % 4 == 3 else ' '.join(words)} {around[1]}"))
    mixed = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).withColumn(
        "item_id", F.lit("other"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for group in (5_000, 7):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(mixed, benchmark, group=group).collect()}
        assert got == {(600 + i, i) for i in range(20)}, group
    clean = decontaminate.clean(mixed, benchmark)
    assert clean.columns == mixed.columns and clean.count() == mixed.count() - 20
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(mixed, benchmark.limit(0)).count() == 0


def test_retrieval_reaches_what_exact_cosines_find(spark):
    """Candidates of the latent space against all cosines of the full TF-IDF vectors."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").orderBy("item_id").collect()]
    known = decontaminate.space(docs, items)
    full = decontaminate.space(docs, items, rank=10_000)
    texts = pa.array([r.text for r in docs.select("text").collect()])
    words, offsets = word_hashes(texts, Powers(), lower=True)
    near, exact = [set(zip(*[x.tolist() for x in decontaminate.retrieved(words, offsets, k, c)[:4]]))
                   for k, c in ((known, decontaminate.COSINE), (full, 0.6))]
    assert len(exact) > 20 and len(exact & near) / len(exact) >= 0.9


def test_replaced_words_of_more_items_than_a_space_holds(spark):
    """Leaks that the later check accepts are retrieved: half the words replaced, or an item of a few words."""
    import random
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(some(rng.randrange(9, 50))) + ". " + " ".join(some(6))) for i in range(decontaminate.RANK + 90)]
    items += [(1000 + i, " ".join(some(6 + i % 5))) for i in range(20)]
    rows = [(i, " ".join(some(rng.randrange(5, 150)))) for i in range(50)]
    for i, text in items[::2]:
        words = text.split()
        body = len(words) - 6 if i < 1000 else len(words)
        for at in rng.sample(range(body), len(words) * 45 // 100 if i < 1000 and body > len(words) // 2 else len(words) // 4):
            words[at] = some(1)[0]
        rows.append((5000 + i, " ".join(some(rng.randrange(0, 90)) + words + some(rng.randrange(0, 90)))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    planted = {(5000 + i, i) for i, _ in items[::2]}
    assert got == planted


def test_items_without_id_and_parts_of_long_items(spark):
    import random
    rng = random.Random(12)
    texts = [sentence(rng, n) for n in (40, 30, 200, 70)]
    items = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (6, texts[3])]
    held = [texts[0], texts[1], " ".join(texts[2].split()[64:128]), " ".join(texts[2].split()[140:165]), texts[3],
            " ".join(texts[2].split()[128:])]
    rows = [(i, f"{sentence(rng, 50)} {t} {sentence(rng, 40)}") for i, t in enumerate(held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for group in (5_000, 1):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark, group=group).collect()}
        assert got == {(0, None), (1, None), (2, 5), (4, 6), (5, 5)}
    assert [r.doc_id for r in decontaminate.clean(docs, benchmark).collect()] == [3]


def test_bound_of_held_words_loses_nothing(spark, docs):
    import random
    rng = random.Random(9)
    texts = [sentence(rng, rng.randrange(1, 200)) for _ in range(60)]
    items = [(i, " ".join(texts[i].split()[3:9 + 4 * i])) for i in range(30)] + [(40, "of of the of the of of")]
    known = decontaminate.space(docs, items, rank=12)
    assert len(known.blocks) > 1 and max(len(b.items) for b in known.blocks) <= 12
    words, offsets = word_hashes(pa.array(texts), Powers(), lower=True)
    found = [set(zip(*[x.tolist() for x in decontaminate.retrieved(words, offsets, known, -2.0, least)[:4]]))
             for least in (0.0, decontaminate.COVER_WITH_ANSWER)]
    held = {f for f in found[0] if decontaminate.verified(
        words, f[1], f[2], offsets[f[0]], offsets[f[0] + 1], known.words[f[3]], known.answers[f[3]])[0] > 0.5}
    assert held and held <= found[1] < found[0]


def test_stages_keep_columns_and_clean_rows(spark, docs, empty):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
        "token-ID / binary output"]
    for table in (docs, empty):
        held = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, "/root/testdata/sf0.001")
            if name.startswith("token"):
                assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
                assert out.count() == held.count()
                break
            assert out.columns == table.columns, name
            path = scratch_path(spark, "test-stage")
            out.write.parquet(path)
            held = spark.read.parquet(path)
    assert set(CLASHING) <= set(docs.columns)
