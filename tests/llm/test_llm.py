import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomwright.llm import chat, decontaminate, jaccard, language_model, lines, mixing, quality, substrings, tokens, urls

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, "One  two"), (6, "a b c " * 3000), (7, "a b c " * 3000 + "d")]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "c": F.lit(1), "rule": F.lit("x"), "source": F.lit(None).cast("string")})


def near(n=60):
    """A base text and copies with a few other words, so that some pairs link and some do not."""
    base = [f"w{i}" for i in range(120)]
    return [(k, " ".join(f"x{k}" if k and i % (3 + k % 11 * 10) == 1 and k % 4 else w for i, w in enumerate(base[: 120 - k % 7]))) for k in range(n)]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    for rows in (ODD, near(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(docs(spark, rows), n, percent).collect()}
        assert got == brute.jaccard(rows, n, percent)
    assert jaccard.join_classes(docs(spark, [])).count() == 0


def test_jaccard_keeps_the_first_of_columns_with_the_same_rows(spark):
    rows = [(1, 10, 2), (1, 20, 5), (2, 10, 1), (2, 20, 3), (3, 10, 0), (3, 30, 0), (4, 10, 3), (4, 20, 6), (4, 30, 9)]
    members = spark.createDataFrame([(k, node, 9, p) for k, node, p in rows], "key long, node long, n int, p int")
    assert sorted(r.key for r in jaccard.first_of_equal(members).collect()) == [2, 3, 4]


def test_jaccard_reads_sets_of_rows_in_a_pair_only(spark, monkeypatch):
    sets, multiply = [], jaccard.multiply
    monkeypatch.setattr(jaccard, "multiply", lambda pairs, s, percent: sets.append(s.count()) or multiply(pairs, s, percent))
    # Short texts share the long one's n-grams, each its own, but no pair can meet the bound.
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), *[(k, " ".join(words[k * 6 - 6 : k * 6 + 2])) for k in range(1, 11)]]
    got = {r.doc_id: r.component_id for r in jaccard.join_classes(docs(spark, rows), 3, 90).collect()}
    assert got == {k: k for k in range(11)}
    assert sum(sets) == 0
    got = {r.doc_id: r.component_id for r in jaccard.join_classes(docs(spark, [(k, " ".join([f"x{k}", *words])) for k in range(3)]), 3, 90).collect()}
    assert got == {0: 0, 1: 0, 2: 0} and 0 < max(sets) <= 3


def test_jaccard_does_not_write_sets(spark, monkeypatch):
    written, stash = [], jaccard.stash
    monkeypatch.setattr(jaccard, "stash", lambda df, what: written.append((what, df.dtypes)) or stash(df, what))
    rows = near()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(docs(spark, rows), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert {what for what, types in written if "binary" in dict(types).values()} == {"sets", "sketch"}  # the sketch's counts


def test_quality(spark):
    got = {r.doc_id: r for r in quality.apply_rules(docs(spark)).collect()}
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[6].n_words == got[6].n_repeat_words == 9000 and got[6].base_failed
    (one,) = quality.apply_rules(docs(spark, [(1, "x y z q x y z\nab\nab\n\n# ab")])).collect()
    assert (one.n_words, one.n_repeat_words, one.n_dup_lines, one.n_symbols, one.word_chars) == (11, 6, 1, 1, 14)
    assert quality.apply_rules(docs(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, "word" * 10, "hot" if i % 3 else f"s{i % 9}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.mix(d).groupBy("source").count().collect()}
    assert all(abs(v - 750) < 130 for v in n.values()) and len(n) == 4
    tiny = d.where("source = 'hot'").union(spark.createDataFrame([(9001, "w", "tiny")], d.schema))
    n = {r.source: r["count"] for r in mixing.mix(tiny).groupBy("source").count().collect()}
    assert abs(n["tiny"] - 40000) < 1500  # a rate far above one part
    assert mixing.mix(docs(spark)).where("text is null").count() >= 0
    assert mixing.mix(docs(spark, [])).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.Example.org/en/12?q"), (2, "http://org"), (3, "x"), (4, None), (5, "https://shop.com/de/a#b"), (6, "http://notorg/"), (7, "http://b.example.org/es/x"), (8, "http://casino.example.net/win/bonus"), (9, "http://news.example.net/en/article/12")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert [got[k].rule for k in range(1, 10)] == ["example.org/en/1", None, None, None, "com/de/", None, "example.org/es/", None, None]
    assert [got[k].verdict for k in (1, 5, 7, 8, 9)] == ["block", "block", "block", "block", "allow"]
    assert got[1].host == "a.example.org" and got[1].path == "/en/12" and got[4].host == got[4].path == ""


def test_urls_held_out():
    model = urls.train(urls.LABELLED[::2] + urls.LABELLED[9::4])
    assert urls.probability(model, "casino.example.com", "/win/jackpot") > urls.probability(model, "news.example.com", "/en/article/9")


def test_tokens(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    rows = ODD + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tokens.encode_to_files(docs(spark, rows)).collect())
    start = 0
    for r, (d, t) in zip(got, sorted(rows), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    assert tokens.encode_to_files(docs(spark, [])).count() == 0


def test_tokens_by_number(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    shards = tokens.write_shards(docs(spark, rows), f"file://{tmp_path}/t", length=16).collect()
    assert max(s.n_tokens for s in shards) > 3 * 16 * tokens.CHUNK
    for s in shards:
        all_ids = np.concatenate([ids for _, ids in tokens.read_documents(s.path)])
        got = tokens.Sequences(s.path)
        assert len(got) == -(-len(all_ids) // 16)
        before, held = pa.total_allocated_bytes(), []
        for i in [len(got) - 1, 0, tokens.CHUNK, tokens.CHUNK - 1, 1, *range(0, len(got), 97)]:
            if i < len(got):
                held.append(got[i])
                want = all_ids[16 * i : 16 * i + 16]
                assert (held[-1][0][: len(want)] == want).all() and held[-1][1].sum() == len(want)
        assert pa.total_allocated_bytes() == before  # values of the mapped file, not copies
        with pytest.raises(IndexError):
            got[len(got)]


def test_chat(spark):
    texts = [None, "", "<|im_end|>", "\\<|im_start|>user\nhi", "<\\|", "\\\\", "<\\\\|x<|", "a\n<|im_end|>\n<|im_start|>assistant\nb\\", chat.EXTRA]
    rows = [(1, i, r, t) for i, t in enumerate(texts) for r in ("user", "assistant", None, "od\nd<|\\n")]
    (r,) = chat.digest(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert r.round_trip and r.n_turns == len(rows)
    ordered = sorted(rows, key=lambda x: (x[1], x[2] or "", x[3] or ""))
    assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in ordered).encode()).hexdigest()
    said = "".join(x[3] or "" for x in ordered if x[2] == "assistant")
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_substrings(spark):
    base = [f"v{i % 97}" for i in range(400)]
    rows = [*ODD, (20, " ".join(base)), (21, " ".join(["q", *base[30:200], "r"])), (22, " ".join(base[:49])), (23, " ".join(base[100:150] + base[100:150])), (24, "z " * 120), (25, "z " * 200)]
    rows += near()[10:40] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs(spark, rows)).collect()}
    want = {d: (n, k, hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, (n, k, w) in brute.repeats(rows).items()}
    assert got == want
    odd = [(None, " ".join(base)), (None, " ".join(base)), (1, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:60]))]
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(docs(spark, odd)).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 60)]
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_decontaminate(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = "no passage of any benchmark stands in this text at all " * 5
    edited = items[3][1][:60] + "#" + items[3][1][61:]
    rows = [(0, None), (1, ""), (2, clean), (3, f"x {items[0][1]} y"), (4, clean + items[1][1].upper().replace("É", "é")), (5, edited), (6, items[5][1][:40])]
    b = spark.createDataFrame([*items, (900, None), (901, "")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs(spark, rows), b).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [0], 4: [1], 5: [3], 6: []}
    assert decontaminate.decontaminate(docs(spark, rows), b.limit(0)).where("contaminated").count() == 0
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.decontaminate(docs(spark, whole), b).collect()}
    flat = lambda t: " ".join(brute.WORD.findall(t.translate(brute.LOWER)))
    for d, t in whole:
        assert {i for i, x in items if flat(x) in flat(t)} <= got[d]


def test_decontaminate_up_to_the_stated_edits():
    import random

    def edited(t, e, rng, width=None):
        """e edits of one character each at different places, within width characters if given."""
        out, where = list(t), rng.sample(range(1, (width or len(t)) - 1), e)
        for i in where:
            out[i] = rng.choice(["#", "", out[i] + "#"])
        return "".join(out)

    rng = random.Random(3)
    for m in (12, 19, 20, 21, 23, 24, 40, 60, 81, 100, 140, 200, 239, 240, 241, 300, 394, 1000):
        item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(m))
        p, e = decontaminate.Patterns([(7, item)]), m // 20
        for width in (None, max(e + 2, m // 3)):
            for _ in range(20):
                text = f"zzz {edited(item, e, rng, width)} zzz"
                assert {i for i, *_ in decontaminate.find(p, text)} == {7}, (m, width)
        assert not decontaminate.find(p, "?".join(item[a : a + 8] for a in range(0, m, 8)))  # more edits
    for a in (0, 17, 120):  # parts of a long item that hold a whole window, edited
        part = item[max(0, 480 - a) : 480 + 240 + a]
        assert {i for i, *_ in decontaminate.find(p, f"zzz {edited(part, 12, rng)} zzz")} == {7}
    assert not decontaminate.find(p, f"zzz {item[:100]} zzz")


def test_language_model(spark):
    import duckdb

    rows = [*ODD, *[(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]]
    got = {r.doc_id: r for r in language_model.score(docs(spark, rows)).collect()}
    con = duckdb.connect()
    con.sql("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, held BOOLEAN)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?)", [(d, t, zlib.crc32(str(d).encode()) % 5 == 1) for d, t in rows])
    for d, n, known, total, base in con.sql(language_model.BASE_SQL).fetchall():
        r = got.pop(d)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(d).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert not got
    assert language_model.score(docs(spark, [])).count() == 0


def test_language_model_is_normalised_and_better_than_counts(spark):
    import numpy as np

    model = language_model.start_model(np.array([5.0, 3, 1]))
    p = np.exp(language_model.log_probabilities(model, np.zeros(3, int), np.ones(3, int), np.arange(3)))
    assert p.sum() == pytest.approx(1)
    held = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_language_model_has_a_vector_for_each_word():
    import numpy as np
    import pyarrow as pa

    words = [f"w{i}" for i in range(2000)]
    v = language_model.Vocabulary(language_model.word_hashes(pa.array(words)), np.arange(2000, 0, -1) + 4, 300, 3_000_000)
    assert sorted(v.numbers(pa.array([language_model.END, *words, "unknown"]))) == list(range(2002))
    model, rng = language_model.start_model(v.class_counts, v.odds), np.random.default_rng(1)
    assert len(model[0]) == 2002
    model[4] += rng.normal(0, 0.5, model[4].shape)
    for one, two in ((0, 0), (3, 700), (1500, v.rare)):
        numbers = np.arange(2002)
        a, b = np.full(2002, one), np.full(2002, two)
        p = language_model.log_probabilities(model, a, b, np.minimum(numbers, v.classes)).astype(float)
        inside = numbers >= v.classes
        p[inside] += language_model.tree_log_probabilities(model, v, a[inside], b[inside], numbers[inside] - v.classes)
        assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_learns_the_order_of_rare_words(spark):
    import random

    rng = random.Random(5)
    tail = [f"r{i} s{i}" for i in range(20) for _ in range(30)]  # less frequent than the words that are classes
    parts = [f"f{i}" for i in range(520) for _ in range(60)] + tail
    rng.shuffle(parts)
    held = [d for d in range(20000) if zlib.crc32(str(d).encode()) % 5 == 1]
    free = [d for d in range(20000) if zlib.crc32(str(d).encode()) % 5 != 1]
    rows = [(free[i // 50], " ".join(parts[i : i + 50])) for i in range(0, len(parts), 50)]
    rows += [(held[i], f"r{i} s{i}") for i in range(20)] + [(held[20 + i], f"r{i} s{(i + 1) % 20}") for i in range(20)]
    got = {r.doc_id: (r.base_score, r.score) for r in language_model.score(docs(spark, rows)).collect()}
    right, wrong = [got[held[i]] for i in range(20)], [got[held[20 + i]] for i in range(20)]
    assert sum(b for b, _ in right) == pytest.approx(sum(b for b, _ in wrong))
    assert sum(s for _, s in right) > sum(s for _, s in wrong) + 1


def test_language_model_does_not_move_texts(spark, monkeypatch):
    seen = []
    stash = language_model.stash
    monkeypatch.setattr(language_model, "stash", lambda df, what: seen.append(df.columns) or stash(df, what))
    rows = [(i, f"one two three rare{i} rare{i}") for i in range(40)] + [(40, None), (41, "")]
    got = {r.doc_id: r for r in language_model.score(docs(spark, rows)).collect()}
    assert seen and not any("text" in columns for columns in seen)
    held = {i for i in range(42) if zlib.crc32(str(i).encode()) % 5 == 1}
    assert [got[i].n_known for i in range(40)] == [4 if i in held else 6 for i in range(40)]
    assert got[40].n_tokens == got[41].n_tokens == 1


def test_language_model_trains_small_texts_in_one_task(spark):
    # Each word of the model stands in the text six times only, so it is not worth a model for each partition.
    rows = [(i, " ".join(f"w{(i * 30 + k) % 400}" for k in range(30))) for i in range(100)]
    got = [{r.doc_id: r.score for r in language_model.score(docs(spark, rows).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")).collect()} for n in (1, 4)]
    assert got[0] == pytest.approx(got[1], rel=1e-5)


def test_language_model_sums_many_and_few_parts():
    import numpy as np

    rows = np.concatenate([np.full(100, 7), np.arange(40), np.full(17, 3), [9]])
    x = np.random.default_rng(2).normal(size=(len(rows), 4)).astype(np.float32)
    groups, want = language_model.Groups(rows), np.zeros((40, 4))
    np.add.at(want, rows, x)
    assert groups.rows.tolist() == list(range(40)) and groups.n.tolist() == np.bincount(rows).tolist()
    assert np.abs(groups.sums(x) - want).max() < 1e-4 and (groups.rows[groups.which] == rows).all()


def test_language_model_finds_words_and_scores_without_sorting(monkeypatch):
    import numpy as np
    import pyarrow as pa

    words = [f"w{i}" for i in range(3000)]
    hashes = language_model.word_hashes(pa.array(words))
    v = language_model.Vocabulary(hashes, np.arange(3000, 0, -1) + 4, 300, 9_000_000)
    model, rng = language_model.start_model(v.class_counts, v.odds), np.random.default_rng(3)
    model[4] += rng.normal(0, 0.5, model[4].shape).astype(np.float32)
    leaf, one, two = (rng.integers(0, n, 5000) for n in (3001 - v.classes + 1, v.rare, v.rare))
    top = np.uint64((1 << 64) - 1)
    asked = np.concatenate([hashes, hashes + np.uint64(1), hashes - np.uint64(1), np.array([0, 1, top], dtype=np.uint64)])
    known = {int(h): n for h, n in zip(v.hashes, v.number, strict=True)}

    def no(*a, **k):
        raise AssertionError("sorted or searched")

    monkeypatch.setattr(language_model, "Groups", no)
    got = language_model.tree_log_probabilities(model, v, one, two, leaf)
    monkeypatch.setattr(np, "searchsorted", no)
    assert v.numbers_of(asked).tolist() == [known.get(int(h), v.rare) for h in asked]
    monkeypatch.undo()
    q, want = model[0][one] * model[1][0] + model[0][two] * model[1][1], np.zeros(len(leaf))
    for i, at in enumerate(leaf):
        while v.parent[at] >= 0:
            node = model[4][v.parent[at] - len(v.parent) // 2 - 1].astype(float)
            x = q[i] @ node[:-1] + node[-1]
            want[i] -= np.logaddexp(0, -x if v.side[at] else x)
            at = v.parent[at]
    assert np.abs(got - want).max() < 1e-4


def test_lines(spark):
    rows = [(0, None), (1, ""), (2, "a b c d e f g h i j\n\nx"), (3, "A b c d e f g h i j\nx y\n\nz"), (4, "a b c d e f g h i k"), (5, "a b c d e f g h q r"), (6, "x\nx")]
    rows += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    before, want = [], {}
    for d, t in sorted(rows):
        keep = []
        for x in [] if t is None else t.split("\n"):
            s = set(brute.WORD.findall(x.translate(brute.LOWER)))
            if not s or all(100 * len(s & y) < 80 * len(s | y) for y in before):
                keep.append(x)
            if s:
                before.append(s)
        want[d] = None if t is None else "\n".join(keep)
    assert {d: r.text for d, r in got.items()} == want
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    odd = [(None, "p q r s"), (None, "p q r s"), (1, "p q r s\n\nt u"), (1, "t u\tv"), (2, "t u"), (2, "t u")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs(spark, odd)).collect())
    assert got == [(False, 0, 1, 0, "p q r s"), (False, 0, 1, 1, ""), (True, 1, 1, 0, "t u\tv"), (True, 1, 3, 1, "\nt u"), (True, 2, 1, 1, ""), (True, 2, 1, 1, "")]


def test_lines_compares_only_pairs_with_like_signatures(spark, monkeypatch):
    tried, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    # Two lines each share their rarest word, and others, but are far from a match; the last is one word off the first.
    rows = [(i, " ".join([f"p{i // 2}", *(f"w{(i * 7 + k * (3 + i % 5)) % 41}" for k in range(11))])) for i in range(40)]
    rows.append((40, rows[0][1].replace("p0", "q")))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(spark, rows), 80).collect()}
    assert got == {i: int(i == 40) for i in range(41)}
    assert 1 <= sum(tried) <= 3


def test_lines_compares_near_copies_in_stars(spark, monkeypatch):
    made, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: made.append(verified(pairs, *rest).count()) or verified(pairs, *rest))
    # All match each other; the first ones are longer, so that the class with the most left is not the earliest.
    common = " ".join(f"c{k}" for k in range(24))
    rows = [(i, f"{common} u{i}" + f" v{i}" * (i < 30)) for i in range(60)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(spark, rows), 80).collect()}
    assert got == {i: int(i > 0) for i in range(60)}
    assert 59 <= sum(made) <= 2 * 60


def test_lines_tells_long_lines_apart_by_signatures(spark, monkeypatch):
    import random

    tried, verified = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: tried.append(pairs.count()) or verified(pairs, *rest))
    # Long lines of common words share tokens of their prefixes; 64 bits of parities do not tell them apart.
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(500)], 180))) for i in range(60)]
    rows.append((60, rows[7][1].replace(" w", " x", 10)))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(spark, rows), 80).collect()}
    assert got == {i: int(i == 60) for i in range(61)}
    assert 1 <= sum(tried) <= 8


def test_lines_writes_hashes_once_and_short(spark, monkeypatch):
    import pyarrow.parquet as pq

    written, stash = [], lines.stash

    def spy(df, what, **options):
        out = stash(df, what, **options)
        files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in out.inputFiles()]
        written.append((what, out.columns, sum(f.row_group(i).column(j).total_compressed_size for f in files for i in range(f.num_row_groups) for j in range(f.num_columns) if f.row_group(i).column(j).path_in_schema.startswith("s."))))
        return out

    monkeypatch.setattr(lines, "stash", spy)
    # More distinct words in a task than the writer's own dictionary holds, each three times.
    rows = [(i, " ".join(f"w{(i // 3 * 40 + k) * 7 % 160000}" for k in range(40))) for i in range(12000)]
    got = lines.dedup_lines(docs(spark, rows).coalesce(1)).agg(F.count("*"), F.sum("n_removed")).first()
    assert tuple(got) == (12000, 8000)
    size = {what: n for what, _, n in written}["lines"]
    assert size < 12000 * 40 * 6
    # Entries and members only have the prefixes' tokens; there is no second copy of the members.
    assert {what for what, columns, _ in written if "key" in columns} == {"entries", "common", "members"}


def test_near_duplicate_stage_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    rows = [(None, one), (None, two), (1, three), (1, four), (0, three), (2, one), (3, two), (3, two), (4, None), (4, None), (None, " ")]
    got = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), SF).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(0, three), (1, four), (2, one), (3, two), (4, None), (4, None), (None, " ")]))
    got = corpus_pipeline.near_duplicate_stage(spark, docs(spark, [(None, one), (None, two), (None, one)]), SF).collect()
    assert sorted(r.text for r in got) == [one, two]


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = corpus_pipeline.quality_stage(spark, d, SF)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    one = corpus_pipeline.near_duplicate_stage(spark, kept, SF)
    groups = brute.jaccard([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in groups.values()})
    clean = corpus_pipeline.decontamination_stage(spark, one, SF)
    leaks = [r.text for r in items.collect()]
    assert not [r.doc_id for r in clean.collect() if any(x in r.text for x in leaks)]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == corpus_pipeline.mixing_stage(spark, clean, SF).count() > 0
