"""Each operator against brute force on small fixtures, with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, embed_dedup, html_extract, masked_lm, mixing, ngram_join, packing, queries, resample, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "")]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 5, 30, 60])))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    for i in range(n, n + 25):  # near and exact copies
        words = rows[rng.randrange(n)][1].split()
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "en", "s0", 0))
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (None, rows[4][1], "en", "s1", 1), (502, " \t\n", "en", "s9", 3), (7, "same id other text with words", "en", "s1", 2)]
    rows += [(503, " ".join(rng.choice(vocab) for _ in range(30_000)), "en", "s2", 9), rows[10]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def shingle_sets(rows):
    out = []
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = WORD.findall(low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def linked_components(rows):
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        k = find(i)
        low[k] = min([x for x in (low.get(k), r[0]) if x is not None], default=None)
    return sorted(((r[0], len(sets[i]), low[find(i)]) for i, r in enumerate(rows)), key=str)


def one_a_group(rows):
    """rows without those that are linked with a row of a smaller id (nulls last; then text)."""
    sets = shingle_sets(rows)
    left, out = list(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            left = [j for j in left if j not in near]
            todo += near
        out.append(rows[min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))])
    return out


def test_ngram_join_equals_brute_force(docs):
    rows = corpus()
    for chunk in (2048, 3):  # with chunks of 3 nearly all blocks are split
        got = ngram_join.join(docs.withColumns({"size": F.lit(1), "key": F.lit("x")}), chunk=chunk)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == linked_components(rows)


def test_ngram_join_of_a_chain_and_a_large_group(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):  # each copy has an edit of its own; neighbours in the chain drift apart
        w = list(base)
        w[(7 * i) % 100] = f"x{i}"
        for k in range(i // 30):
            w[50 + k] = "drift"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = ngram_join.join(spark.createDataFrame(rows, DOCS), chunk=16)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == linked_components(rows)


def test_ngram_join_of_long_texts_with_common_passages(spark):
    """Texts that meet in many blocks: some linked, most only alike. Small chunks split the blocks into portions."""
    rng = random.Random(8)
    passages = [" ".join(f"p{k}x{rng.randrange(10**6)}" for _ in range(300)) for k in range(6)]
    rows = []
    for i in range(70):
        parts = rng.sample(passages, 3) + [" ".join(f"o{i}x{j}" for j in range(rng.choice([20, 60, 200, 700])))]
        rows.append((i, " ".join(parts), "en", "s", 0))
    for i in range(70, 90):
        words = rows[rng.randrange(70)][1].split()
        words[rng.randrange(len(words))] = f"e{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    d = spark.createDataFrame(rows, DOCS)
    for chunk in (1024, 16):
        got = ngram_join.join(d, chunk=chunk)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == linked_components(rows)


def test_a_pair_belongs_to_its_first_common_block(spark):
    rng = random.Random(4)
    held = {node: rng.sample(range(-60, 60), rng.choice([3, 20, 60])) for node in range(30)}
    members = spark.createDataFrame([(b or 99, n) for n, bs in held.items() for b in bs], "block long, node long")
    first = {r.node: np.frombuffer(bytes(r.first).ljust(8 * ngram_join.FIRST, b"\0"), ">i8")[None] for r in ngram_join.lowest(members).collect()}
    several = 0
    for a in held:
        for b in range(a):
            common = {x or 99 for x in held[a]} & {x or 99 for x in held[b]}
            owners = [k for k in common if ngram_join._owned(k, first[a], first[b])[0]]
            assert (min(common) in owners) if common else not owners
            several += len(owners) > 1
    assert several < 60


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(400, rng.integers(20, 60), replace=False).tolist()) for _ in range(80)]
    sets += [set(list(s)[2:]) for s in sets[:40]]
    points = np.stack([ngram_join.group_counts(np.array(sorted(s), np.uint64)) for s in sets])
    t = ngram_join.Tree(points, np.array([len(s) for s in sets]))
    found = {(min(a, b), max(a, b)) for p, q, _ in ngram_join.tree_join(t, t, 80) for a, b in zip(p.tolist(), q.tolist())}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert true <= found and len(found) < 1000


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.join(d).count() == 0
    assert mixing.mix(d).count() == 0 and mixing.training_order(d).count() == 0
    assert packing.pack(d).count() == 0
    assert decontaminate.find_leaks(d, bench).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.fit(d, labels)).count() == 0
    assert resample.resample(d, labels).count() == 0
    assert masked_lm.score(d, masked_lm.train(d)).count() == 0


def test_mixing_takes_near_targets_and_agrees(docs):
    rows = mixing.mix(docs.withColumn("target", F.lit("clash"))).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.position))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert [r.size for r in sorted(rows, key=lambda r: (str(r.doc_id), r.size))] == [len(WORD.findall(r[1] or "")) for r in sorted(corpus(), key=lambda r: (str(r[0]), len(WORD.findall(r[1] or ""))))]
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
    for source, own in by.items():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) < 1, source
    assert sum(own[0].target for own in by.values()) == pytest.approx(total)
    free = [o[0] for o in by.values() if o[0].target < 3 * o[0].source_size - 1e-6]
    names = sorted([s for s in by if s is not None]) + [None] * (None in by)
    assert len({round(r.target / mixing.WEIGHTS[names.index(r.source) % 3], 6) for r in free}) <= 1


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 20, 40):
        sizes = {(f"s{i:02}" if i else None): rng.choice([0, 3, 50, 1000, 20000]) for i in range(n)}
        if not sum(sizes.values()):
            continue
        order = sorted(s for s in sizes if s is not None) + [None]
        weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
        total = sum(sizes.values())
        target = {s: total * weight[s] / sum(weight.values()) for s in order}
        while True:
            capped = {s for s in order if target[s] >= 3 * sizes[s] - 1e-9}
            free = [s for s in order if s not in capped]
            rest = total - sum(3 * sizes[s] for s in capped)
            new = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
            if all(abs(new[s] - target[s]) < 1e-9 for s in order):
                break
            target = new
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert set(got) == set(sizes)
        for s in got:
            assert got[s] == pytest.approx(target[s], abs=1e-6), (n, s)


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        u = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.inverse(F.col("u"), knots)).collect()
        whole = mixing.integral(knots)
        for r in u:
            part = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                t = min(max(r.t, t0), t1)
                part += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
            assert part / whole == pytest.approx(r.u, abs=1e-9)


def test_training_order_repeats_whole_rows(docs):
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    m = {}
    for r in mixing.mix(docs).collect():
        m[r.doc_id] = m.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in m.items() if v}


def test_packing_round_trip(spark):
    rows = corpus(3) + [(900, "two  spaces\n\nand \xa0 more  ", "en", "s", 0), (901, "naïve ünïcode 你好 🙂", "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    with open(packing.VOCABULARY, "rb") as f:
        enc = packing.Encoder(f.read())
    texts = {}
    for r in packing.pack(d, row=128, window=5000).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        pos = np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, (lo, hi) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert pos[lo:hi].tolist() == list(range(hi - lo))
            texts.setdefault((r.doc_ids[k]), []).append((r.pieces[k], ids[lo:hi].tolist()))
    expect = {}
    for r in rows:
        if r[1]:
            expect.setdefault(r[0], []).append(r[1])
    assert set(texts) == set(expect)
    for k, pieces in texts.items():
        if len(expect[k]) == 1:
            ids = [i for _, p in sorted(pieces, key=lambda p: p[0]) for i in p]
            assert ids[-1] == packing.EOS and enc.core.decode(ids[:-1]) == expect[k][0]


def test_encoder_equals_plain_encoding():
    rng = random.Random(2)
    with open(packing.VOCABULARY, "rb") as f:
        enc = packing.Encoder(f.read())
    for _ in range(3000):
        s = "".join(rng.choice(" ab\n\t1.é\xa0 'sé") for _ in range(rng.randint(1, 14)))
        assert enc(s) == enc.core.encode_ordinary(s)


def test_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, f in enumerate(bins) if f >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(50 - n)
        got = packing.best_fit(lengths, 50)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        assert sorted(50 - sum(lengths[i] for i in row) for row in got) == sorted(bins)


def test_url_rules(spark):
    urls = ["http://www.example.com/en/70?x=/en/8", "https://EXAMPLE.com/en/8", "x://a.net/de/", "http://example.net/de/81", "ftp://b.org/es/#a", "http://borg/es/", "com/en/", None, "", "http://xcom/en/", "http://com/en/", "http://example.com:80/en/7", "http://a.com?/en/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(d, queries.RULES).collect()}
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [r for r in rules if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
        best = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
        assert got[i] == (host, path, *best), u


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/x>Menu</a></nav><div class='side bar'>shared line</div>{}<footer>&copy; f</footer></body></html>"


def test_html_extraction(spark):
    rows = [
        (1, "http://a/x/1", PAGE.format("<article><h1>T &amp; U</h1><p><b>one\n two<br><p>three&nbsp;&eacute;<script>var x='</p>'</script><!-- no --></article>")),
        (2, "http://a/x/2", PAGE.format("<p>own text</p><div class=comments><p>reader</p></div><form><p>name</p></form>")),
        (3, "http://a/x/3", PAGE.format("<p>other text</p><aside>aside</aside>")),
        (4, None, None), (5, "", ""), (6, "http://b/", "<p>plain <i>in</i>line"), (2, "http://a/x/2", PAGE.format("<main><p>again</main>")),
    ]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")), block_pages=2).collect()
    text = {}
    for r in got:
        assert r.n_chars == len(r.text)
        text.setdefault(r.page_id, []).append(r.text)
    assert text[1] == ["T & U\none two\nthree é"]
    assert sorted(text[2]) == ["again", "own text"]
    assert text[3] == ["other text"] and text[4] == text[5] == [""] and text[6] == ["plain inline"]


def test_longest_common_lines():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        c = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(c) == t[-1][-1] and all(any(x == a[i] for x in rest) for i in sorted(c))


def test_embedding_groups_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    x[40:80] = x[3] + 0.15 * rng.standard_normal((40, 16))
    x[80:90] = x[5]
    x[100:140] = x[100] + 0.4 * rng.standard_normal((40, 16))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [float("inf")] * 16)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("key", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(d, cell_rows=20, chunk=8, sigmas=8.0).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T >= 0.9
    root = list(range(300))
    for _ in range(300):
        new = [min(root[j] for j in np.flatnonzero(s[i])) for i in range(300)]
        if new == root:
            break
        root = new
    for i in range(300):
        assert got[i] == (s[i].sum() - 1, root[i], root[i] == i)
    for i in (400, 401, 402, 403, 404, 407):
        assert got[i] == (0, i, True)
    assert got[405] == (1, 405, True) and got[406] == (1, 405, False)


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    terms = [toxicity.Term(t) for t in ("idiot", "scum", "worthless", "moron", "disgusting")] + [toxicity.Term("lowei", True)]
    auto = toxicity.Automaton(terms)
    rng = random.Random(5)
    words = ["loweixyz", "lowei", "lowe", "low"]
    for _ in range(3000):
        w = list(rng.choice(terms).text)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i", "o", "s"])
        words.append("".join(w) or "x")
    n, at, verdict, _ = auto.find(" ".join(words))
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    found = dict(zip(at.tolist(), verdict.tolist()))
    for w, p in zip(words, starts.tolist()):
        ds = [(0 if w.startswith(t.text) else 99) if t.stem else distance(w, t.text) for t in terms]
        ok = [d for d, t in zip(ds, terms) if d <= t.edits]
        assert found.get(p, 0) == (0 if not ok else 1 if min(ok) == 0 else 2), w


def test_quotation_window():
    text = 'he said "you idiot there" and left. idiot'
    assert toxicity.quoted(text, text.index("idiot")) and not toxicity.quoted(text, text.rindex("idiot"))


def test_toxicity_learns_and_holds(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = ["".join(rng.choice("bcdfghaeiou") for _ in range(6)) for _ in range(40)]
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(40), rng.choice(["zumble", "krotz", "fleemish"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "fine words with no harm " * 3000), (None, "you zumble krotz and fleemish zumble"), (903, "zumbel krotzz fleemizh " * 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id < 300"))
    assert {t.text for t in model.terms} >= {"zumble", "krotz", "fleemish"}
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(300, 400))
    assert got[900] < 0.5 and got[901] < 0.5 and got[902] < 0.5 and got[None] >= 0.5


def test_inflected_forms_lose_no_misspelled_hit():
    def lexicon(toxic):
        counts = {}
        for y, texts in ((0, toxic), (1, [f"plain{i} harmless words here" for i in range(400)])):
            for t in texts:
                for w in toxicity._terms_of(t):
                    c = counts.setdefault(w, [0, 0])
                    c[y] += 1
        return toxicity.choose({w: tuple(c) for w, c in counts.items() if c[0] >= 2 or c[1]}, len(toxic), 400)

    def hits(terms):
        w, letters = "zumblex", "abcdefghijklmnopqrstuvwxyz1"
        edits = {w[:i] + c + w[i + k :] for i in range(len(w)) for c in ["", *letters] for k in (0, 1)}
        auto = toxicity.Automaton(terms)
        return {e for e in edits if len(auto.find(e)[1])}

    rows = ["you zumblex there"] * 40
    few, more = lexicon(rows), lexicon(rows + ["the zumblexes", "a zumblexing", "so zumblexic"] * 3)
    assert not any(t.stem for t in few) and any(t.stem for t in more)
    assert len(hits(few)) > 100 and hits(few) <= hits(more)


def test_leaks_exact_and_edited(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfghaeiou") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(50, "tiny item"), (51, None), (52, "")]
    rows = []
    for i in range(60):
        w = [word() for _ in range(120)]
        if i % 3 == 0:
            leak = items[i % 20][1].split()
            if i % 2:
                for _ in range(6):
                    leak[rng.randrange(30)] = word()
                del leak[rng.randrange(len(leak))]
            w[40:40] = [x.upper() + "," for x in leak]
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " ".join(word() for _ in range(20_000)) + " " + items[1][1]), (103, "a tiny item here"), (None, items[2][1]), (0, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (2_000_000, 50):
        got = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, bench, block_words=size).collect()), key=str)
        expect = [(i, i % 20) for i in range(0, 60, 3)] + [(102, 1), (103, 50), (None, 2), (0, 0)]
        assert got == sorted(expect, key=str)
    for size in (2_000_000, 50):
        left = {r.doc_id for r in decontaminate.remove_leaks(d, bench, block_words=size).collect()}
        assert left == {r[0] for r in rows} - {e[0] for e in expect}


def test_leaks_that_many_documents_hold_edited(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("bcdfghaeiou") for _ in range(5))
    item = [word() for _ in range(30)]
    rows = [(0, " ".join([word() for _ in range(10)] + item))]
    for i in range(1, 1001):  # each fifth word changed: two fifths of the 3-grams are left, all of them in every copy
        rows.append((i, " ".join([word() for _ in range(10)] + [word() if k % 5 == 4 else w for k, w in enumerate(item)])))
    rows += [(2000 + i, " ".join(item[:3] + [word() for _ in range(40)])) for i in range(300)]  # a stock phrase is no leak
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(d, bench).collect()) == list(range(1001))
    assert {r.doc_id for r in decontaminate.remove_leaks(d, bench).collect()} == {2000 + i for i in range(300)}


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.randrange(1, 6) for _ in range(rng.randint(1, 12))] for _ in "ab")
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = 0.0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
                best = max(best, h[i + 1][j + 1])
        got, first, last = decontaminate.align(np.array(a, np.uint64), [np.array(b, np.uint64), np.array([9], np.uint64)])[0]
        assert got == pytest.approx(best / (2 * len(a))) and (best == 0 or 0 <= first <= last < len(b))


def test_resampling(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "well", "text"] if i % 3 else ["@@", "zz", "junk", "!!"]) for _ in range(50))) for i in range(300)]
    rows += [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    target = spark.createDataFrame([(i,) for i in range(100) if i % 3], "doc_id long")
    got = resample.resample(d, target, share=0.5)
    ids = sorted(r.doc_id for r in got.collect())
    assert len(ids) == 150 and all(i % 3 for i in ids) and ids == sorted(r.doc_id for r in resample.resample(d.repartition(5), target, share=0.5).collect())


def test_largest_is_exact(spark):
    rng = random.Random(1)
    vals = [(i, float(rng.choice([rng.gauss(0, 1), 2.0]))) for i in range(3000)]
    d = spark.createDataFrame(vals, "doc_id long, key double")
    for k in (0, 1, 700, 2999, 3000, 5000):
        got = sorted((r.key for r in resample.largest(d, "key", k, bins=8, small=20).collect()), reverse=True)
        assert got == sorted((v for _, v in vals), reverse=True)[:k]


def test_masked_model_beats_word_shares(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a b c d e f", "u v w x y z"]) for _ in range(60))) for i in range(120)] + [(500, None), (501, ""), (None, "a b c"), (502, "a b c d e f " * 4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    voc, net = masked_lm.train(d)
    flat = masked_lm.start(voc.prior)
    flat["out"][:] = 0
    a = {r.doc_id: r for r in masked_lm.score(d, (voc, net)).collect()}
    b = {r.doc_id: r for r in masked_lm.score(d, (voc, flat)).collect()}
    assert a[0].log_prob > b[0].log_prob + 50 and a[0].n_words == 360
    assert (a[500].n_words, a[500].log_prob, a[500].mean_log_prob) == (0, 0.0, None) and a[502].n_words == 24000 and a[None].n_words == 3


def test_masked_model_learns_every_place(spark):
    # texts of period 8 with no word twice in it: each word follows from its neighbours, wherever it stands
    d = spark.createDataFrame([(i, "ant bee cow dog elk fox gnu hen " * 60) for i in range(400)], "doc_id long, text string")
    got = masked_lm.score(d, masked_lm.train(d)).first()
    assert got.n_words == 480 and got.mean_log_prob > -0.5


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(5)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = next(r for r in rows if r[1] and len(r[1].split()) == 60)
    spark.createDataFrame([(1, " ".join(leak[1].split()[10:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = queries.table(spark, str(tmp_path), "documents")
    a = corpus_pipeline.drop_toxic(spark, d, str(tmp_path))
    assert a.columns == d.columns and a.count() == len(rows)
    b = corpus_pipeline.one_of_each_group(spark, a, str(tmp_path))
    assert b.columns == d.columns and sorted(map(str, b.collect())) == sorted(map(str, spark.createDataFrame(one_a_group(rows), DOCS).collect()))
    c = corpus_pipeline.drop_leaks(spark, b, str(tmp_path))
    assert c.columns == d.columns and leak[0] not in {r.doc_id for r in c.collect()}
    m = corpus_pipeline.mix_sources(spark, c, str(tmp_path))
    assert m.columns == d.columns
    m.write.parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in m.collect()]
    packed = corpus_pipeline.pack_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    assert [r.position for r in packed] == sorted(r.position for r in packed)
    once = sorted({(row, i) for r in packed for row, i in zip(r.rows, r.doc_ids)})
    assert [i for _, i in once] == order  # rows are numbered in training order, each copy on its own
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == len(packed) and leak[0] not in {i for r in out.collect() for i in r.doc_ids}


def test_packs_come_in_position_order(spark):
    rows = [(i % 7, " ".join(f"w{i}" for _ in range(5 + i % 40)), 1000 - i) for i in range(300)] + [(None, "no place", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, place long").repartition(5)
    got = packing.pack(d, row=64, position="place", run=256).collect()
    place = {r[2]: r[1] for r in rows}
    with open(packing.VOCABULARY, "rb") as f:
        enc = packing.Encoder(f.read())
    assert [r.position for r in got] == sorted((r.position for r in got), key=lambda p: (p is not None, p)) and [r.pack_id for r in got] == sorted(r.pack_id for r in got)
    pieces = {}
    for r in got:
        ids = np.frombuffer(r.input_ids, "<u2")
        for k, (lo, hi) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            pieces.setdefault(r.rows[k], {})[r.pieces[k]] = ids[lo:hi].tolist()
    texts = [enc.core.decode([i for k in sorted(p) for i in p[k]][:-1]) for _, p in sorted(pieces.items())]
    assert texts == [place[k] for k in sorted(place, key=lambda p: (p is not None, p))]  # lossless also for repeated ids


CLASH = ["rank", "size", "target", "_before", "toxic", "good", "_id", "_score", "_k1", "_position", "position", "taken", "group", "node", "key", "a.b"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in corpus(6, 30)]
    wide = spark.createDataFrame(rows, DOCS).select("*", *[F.concat_ws("-", F.lit(c), "doc_id", "source").alias(c) for c in CLASH])
    spark.createDataFrame([(i, 1, int(i < 2)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that any document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        docs = wide.where("false") if empty else wide
        docs.write.parquet(f"{tmp_path}/docs{empty}")
        docs = spark.read.parquet(f"{tmp_path}/docs{empty}")
        every = {str(r) for r in docs.collect()}
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == wide.columns
                docs.write.parquet(f"{tmp_path}/stage{k}{empty}")
                docs = spark.read.parquet(f"{tmp_path}/stage{k}{empty}")
                assert {str(r) for r in docs.collect()} <= every
        assert (docs.count() == 0) == empty


def test_stages_of_null_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None,) * 5] * 3, DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.count() == (3 if k < 3 else 0)  # without words nothing is a copy, a leak, or read by the mix


def test_equal_rows_have_positions_of_their_own(spark):
    rows = [(1, "a b c d", "en", "x", 1)] * 4 + [(2, "e f g h", "en", "y", 1)] * 2
    d = spark.createDataFrame(rows, DOCS)
    out = [tuple(r) for r in mixing.training_order(d).collect()]
    assert len(out) == sum(r.copies for r in mixing.mix(d).collect()) and set(out) <= set(rows)


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = text(1).rsplit(" ", 1)[0] + " edited"
    rows = [(1, text(1), "en", "a", 1), (5, near, "en", "a", 1), (None, text(1), "en", "b", 1)]  # a null id is last
    rows += [(2, text(2), "en", "a", 1)] * 3 + [(2, text(2), "en", "b", 1)]  # repeated rows of one id
    rows += [(None, text(3), "en", "a", 1), (None, text(3), None, "a", 1), (None, text(3), "en", None, 1)]  # null ids alone
    rows += [(5, text(4), "en", "a", 1), (1, text(5), "en", "a", 1)]  # other texts under the ids of copies
    rows += [(6, text(6) + " b", "en", "a", 1), (6, text(6) + " a", "en", "a", 1)]  # of one id the smallest text
    bare = [(7, None, None, None, None), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (None, " ", "en", "a", 1)]
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows + bare, DOCS).repartition(3), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    expect = [(1, text(1)), (2, text(2)), (None, text(3)), (5, text(4)), (1, text(5)), (6, text(6) + " a"), *(r[:2] for r in bare)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(expect, key=str)


def test_low_dimensional_vectors_lose_no_link(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 6)) @ np.linalg.qr(rng.standard_normal((384, 6)))[0].T
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    got = embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert [n for _, n in sorted((r.vec_id, r.n_links) for r in got.collect())] == links.sum(axis=1).tolist()


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><body><p>hello world</p></body></html>", "hello world"),
    ("<article><p>a</p><p class=advert>BUY</p><ul><li class='share'>s<li>keep</ul><p class='comment'>c</p>z</article>", "a\nkeep\nz"),
    ("<div class='social-science'>x</div><section id='related-work'>y</section><div class='ad-box'>n</div>", "x\ny"),
])
def test_page_markup(page, text):
    assert html_extract.main_text(html_extract.lines(page), []) == text


def test_terms_of_any_script_and_number_of_automata():
    terms = [toxicity.Term("你好世界"), toxicity.Term("ab"), toxicity.Term("terrible"), toxicity.Term("한국어욕설")]
    for lexicon in (toxicity.Lexicon(terms), toxicity.Lexicon(terms, cells=64)):
        for text, at in (("说 你好世界。", 2), ("ab", 0), ("a terible day", 2), ("(한국어욕설)", 1)):
            assert lexicon.find(text)[1].tolist() == [at]
        assert len(lexicon.find("你好 世界 abc")[1]) == 0
    assert len(toxicity.Lexicon(terms, cells=64).parts) > 1


def test_every_labelled_text_counts_once_per_group_of_copies(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    rows = [text() for _ in range(50)]
    near = rows[0].rsplit(" ", 1)[0] + " other"
    every = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*rows, rows[0], near])], "row long, text string, toxic int")
    assert toxicity._firsts(every) == set(range(50))


def test_alignment_memory_is_bounded_for_long_items(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    rows = [(i, " ".join(["intro"] * 5 + item + ["end"] * 5)) for i in range(70)] + [(99, "nothing here")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.score, r.first_word) for r in got) == [(i, 1.0, 5) for i in range(70)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    key = lambda d: sorted(tuple(str(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in d.astype(object).where(d.notna(), None).itertuples(index=False))
    assert key(got) == key(want)


def test_cells_of_isotropic_vectors_fill_all_dimensions():
    x = np.random.default_rng(2).standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embed_dedup.spherical_kmeans(x, 8)
    cov, few = embed_dedup.spread(x, c)
    assert few.max() < 1.5 / 32 and np.linalg.eigvalsh(cov)[-1] < 1.5 / 32


def links_of(x: np.ndarray) -> list[int]:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    return links.sum(axis=1).tolist()


def shifted(rng: np.random.Generator, n: int = 3000, dims: int = 384) -> np.ndarray:
    """Isotropic unit vectors, and a copy of each that moved along one direction that all copies share."""
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.standard_normal(dims)
    return np.concatenate([x, x + 0.43 * d / np.linalg.norm(d)])


def mixed(rng: np.random.Generator, n: int = 4000, more: int = 400, k: int = 5, dims: int = 384) -> np.ndarray:
    """Isotropic vectors and some that fill few dimensions."""
    return np.concatenate([rng.standard_normal((n, dims)), rng.standard_normal((more, k)) @ np.linalg.qr(rng.standard_normal((dims, k)))[0].T])


@pytest.mark.parametrize("make", [shifted, mixed])
def test_shifted_and_mixed_vectors_lose_no_link(spark, make):
    x = make(np.random.default_rng(1))
    got = embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert [n for _, n in sorted((r.vec_id, r.n_links) for r in got.collect())] == links_of(x)


def test_a_result_outlives_another_release(spark):
    from millrace.llm import common

    first = embed_dedup.near_duplicates(spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(9)], "vec_id long, embedding array<double>"))
    rows = sorted(first.collect())
    before = common.made()
    second = common.materialize(spark.range(5))
    third = common.materialize(second)
    common.release(newest=1, but=before)
    assert sorted(first.collect()) == rows and third.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        second.count()


def test_malformed_pages_are_parsed_in_linear_time():
    import time

    began = time.monotonic()
    for page in ("<a " * 350_000, "<a " * 350_000 + ">x", '<a x="' * 170_000 + ">x", "<script>a</script>b" * 50_000, "<!--" * 250_000, "<" * 1_000_000, "<p '" * 250_000):
        html_extract.lines(page)
    assert time.monotonic() - began < 20
    began = time.monotonic()
    html_extract.lines("<a " * 350_000)
    assert time.monotonic() - began < 1


@pytest.mark.parametrize("page, text", [
    ("<p>x <button>b</button> y</p>", "x y"),
    ("<p alt=\"x'>stray", "stray"),
    ("<p don't>it's</p><p title='a>b'>t</p>", "it's\nt"),
    ("<div class='user-comments'>c</div><div class=adContainer>d</div><div id=cookieBanner>e</div><p>a</p>", "a"),
    ("a < b <b>c</b> <i", "a < b c <i"),
])
def test_page_markup_that_is_odd(page, text):
    assert html_extract.main_text(html_extract.lines(page), set()) == text


def page_rows() -> list[tuple]:
    """Pages without containers: a template of the host, an article; some are copies of one article on neighbouring urls."""
    rng = random.Random(8)
    line = lambda k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(12))
    rows = []
    for h in range(3):
        top, foot = line("menu"), line("foot")
        for i in range(40):
            body = [line("word") for _ in range(5)] if i % 4 else body_of(h)
            rows.append((1000 * h + i, f"http://h{h}.com/{i // 8}/{i:03d}", f"<p>{top}</p>" + "".join(f"<p>{b}</p>" for b in body) + f"<p>{foot}</p>"))
    lone = [line("alone") for _ in range(3)]
    return rows + [(9000 + i, f"http://twins.com/{i}", "".join(f"<p>{b}</p>" for b in [*lone, f"own menu {i}"])) for i in range(2)] + [(9100, None, None), (9101, "", "<p>only</p>")]


def body_of(h: int) -> list[str]:
    return [f"the same article {h} with its sentence {k} and some more words" for k in range(6)]


def test_pages_differ_from_their_nearest_page_that_is_no_copy(spark):
    rows = page_rows()
    host = lambda u: (u or "").split("://")[-1].split("/")[0] if "://" in (u or "") else ""
    path = lambda u: "/" + u.split("://")[-1].split("/", 1)[1] if "://" in (u or "") else ""
    ordered = sorted(rows, key=lambda r: (host(r[1]), path(r[1]), r[0]))
    want = {}
    for i, (k, u, h) in enumerate(ordered):
        own = [x for x, _, _ in html_extract.lines(h)]
        some = [(j, ordered[j]) for j in [*range(i - 1, i - 4, -1), *range(i + 1, i + 4)] if 0 <= j < len(ordered) and host(ordered[j][1]) == host(u)]
        some = [r for _, r in sorted(some, key=lambda x: -html_extract._prefix(path(x[1][1]), path(u)))]
        gone: set = set()
        for r in some:
            other = [x for x, _, _ in html_extract.lines(r[2])]
            shared = html_extract.common_lines(own, other)
            if 3 * sum(len(own[n]) for n in shared) <= 2 * sum(map(len, own)):
                gone = shared
                break
        want[k] = "\n".join(x for n, x in enumerate(own) if n not in gone)
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (256, 5):
        got = {r.page_id: r.text for r in html_extract.extract(d.repartition(4), block_pages=size).collect()}
        assert got == want
    assert want[9000].endswith("own menu 0") and want[4].split("\n") == body_of(0) and not any("menu" in want[1000 * h + i] for h in range(3) for i in range(40))
