import collections
import math
import random
import zlib

import numpy as np
import pytest
from brute import components, corpus, covered, edit_search, fingerprint, lower, removal, words
from pyspark.sql import functions as F

from tessera.llm import components as graph
from tessera.llm import decontam, html_main, langid, lattice_lm, mixing, quality, repeats, sieve, simhash, suffix_array, suffix_tree, toxicity
from tessera.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, node string, copy int, key string, row string"


def documents(spark, texts, ids=None):
    """A table with extra columns whose names the operators also use."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", len(t or ""), "x", "y", "z", 1, "k", "r") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def multiset(rows):
    return collections.Counter(map(tuple, rows))


# quality


def expected_quality(text):
    w, out = words(text), {}
    out["n_words"], out["word_chars"] = len(w), sum(map(len, w))
    out["n_symbols"] = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += sum(map(len, words(x)))
        seen.add(x)
    out["n_dup_lines"], out["n_lines"], out["dup_line_chars"] = dup, len(lines), dup_chars
    for n in range(5, 11):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count, before, later, twice = collections.Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                twice.update(range(i, i + n))
            if g in before:
                later.update(range(i, i + n))
            before.add(g)
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in later)
        if n == 5:
            out["n_repeat_words"] = len(twice)
    return out


def test_quality_matches_brute_force(spark):
    texts = corpus(1, vocabulary=6) + ["a b\na b\n \n#*$%&|<>", "x " * 9, "long " * 50_000, "\x1c one\x85two three"]
    found = quality.judged(documents(spark, texts).withColumn("kept", F.lit(1))).collect()
    assert len(found) == len(texts)
    for r in found:
        want = expected_quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_plain_text(spark):
    plain = " ".join(f"word{i}" for i in range(200))
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents(spark, [plain, plain + "\n" + plain])).collect()}
    assert kept == {0: True, 1: False}


# SimHash


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = [f"v{rng.randint(0, 500)}" for _ in range(rng.randint(1, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            changed = list(base)
            changed[rng.randrange(len(base))] = "New"
            texts.append("  ".join(changed))
    texts += [None, "", " \n", "A b", "a B", texts[0]]
    fps = [fingerprint(t, 4) for t in texts]
    want = components(fps, range(len(texts)), 4)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [found[i]["fp"][0] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [found[i]["component_id"] for i in range(len(texts))] == want


@pytest.mark.parametrize("limits", [{1 << 24: 3}, {1: 2}])
def test_hamming_balls_find_every_link(spark, limits, monkeypatch):
    monkeypatch.setattr(simhash, "SEGMENTS", limits)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v, [v]) for v in signed], "node long, fp array<long>")
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(table, 4)).collect()}
    want = components(values, signed, 4)
    assert [found.get(v, v) for v in signed] == want


def test_representatives_keep_one_of_each_group(spark):
    rng = random.Random(5)
    base = [f"v{rng.randint(0, 9000)}" for _ in range(400)]
    near = list(base)
    near[100:110] = ["q"] * 10
    other = [f"u{rng.randint(0, 9000)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(near), " ".join(base), " ".join(other), None, ""]
    left = simhash.representatives(documents(spark, texts, [5, 3, 7, 9, 1, None]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 9]
    assert left.columns == documents(spark, []).columns
    repeated = documents(spark, ["same text here"] * 3, [1, 1, 1])
    assert simhash.representatives(repeated).count() == 1


def test_large_keys_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = random.Random(7)
    # one template: all values share the lowest segment
    values = sorted({rng.getrandbits(30) << 30 & ~(rng.getrandbits(60) & rng.getrandbits(60)) | 5 for _ in range(60)} | {(1 << b | 1 << c) << 30 | 5 for b in range(12) for c in range(b)})
    table = spark.createDataFrame([(v, [v]) for v in values], "node long, fp array<long>")
    rows = simhash.looked_up(table, [(0, 21), (21, 21), (42, 22)], 1)
    assert max(r["count"] for r in rows.groupBy("key").count().collect()) > 100
    assert max(r["count"] for r in simhash.bounded(rows).groupBy("key").count().collect()) <= 3 * 16
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(table, 4)).collect()}
    want = components(values, values, 4)
    assert [found.get(v, v) for v in values] == want


def jaccard(a, b, width=5):
    one, other = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a, b))
    return len(one & other) / len(one | other)


@pytest.mark.parametrize("block", [8, 512])
def test_representatives_match_brute_force_similarity(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    texts, pairs = [], []
    for k in range(300):
        base = [f"k{k}v{rng.randint(0, 9000)}" for _ in range(rng.randint(150, 400))]
        near = list(base)
        # a run of one in n changed words breaks about one in n shingles: similarities from 0.70 to 0.90
        n = max(1, round(len(base) * rng.uniform(0.05, 0.18)) - 4)
        at = rng.randint(5, len(base) - n - 5)
        near[at : at + n] = [f"z{k}z{i}" for i in range(n)]
        pairs.append(jaccard(base, near))
        texts += [base, near]
    family = [f"f{i}" for i in range(300)]
    texts += [[*family[: 30 * k], "odd", str(k), *family[30 * k :]] for k in range(10)] * 2
    left = {r["doc_id"] for r in simhash.representatives(documents(spark, [" ".join(t) for t in texts])).collect()}
    assert {d for d in left if d >= 600} == {600}
    like = [k for k, s in enumerate(pairs) if s >= 0.8]
    assert len(like) > 80 and sum(s < 0.8 for s in pairs) > 80
    assert all(2 * k in left for k in range(300))
    assert all(2 * k + 1 in left for k, s in enumerate(pairs) if s < 0.8)
    assert sum(2 * k + 1 not in left for k in like) >= 0.98 * len(like)


def test_wide_fingerprints_are_of_shingle_sets():
    words = [f"w{i}".encode() for i in range(60)]
    once, often = b" ".join(words), b" ".join(words[:30] * 9 + words)
    apart = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(simhash.fingerprint(once, 5, 512), simhash.fingerprint(often, 5, 512)))
    assert apart <= 78


def test_representatives_tell_rows_without_or_with_shared_ids_apart(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(6)]
    docs = documents(spark, texts + texts[:1], [None, None, None, 4, 4, 4, None])
    assert sorted(r["text"] for r in simhash.representatives(docs).collect()) == sorted(texts)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 102, 103: 102}
    assert graph.components(links.limit(0)).count() == 0


# lattice


def test_lattice_sums_all_segmentations():
    model = lattice_lm.Lattice({"▁a": -1.0, "▁": -2.0, "a": -1.5, "b": -2.5, "ab": -3.0, "▁ab": -4.0}, [-6.0] * 256, -1.0)
    ways = [("▁a", "b"), ("▁", "a", "b"), ("▁", "ab"), ("▁ab",)]
    want = math.log(sum(math.exp(sum(model.pieces[p] for p in way)) for way in ways))
    assert model.word("ab") == pytest.approx(want)
    assert model.word("é") == pytest.approx(-2.0 - 12.0)
    assert model.word("a" * 3000) < -1000  # no underflow


@pytest.mark.parametrize("head", [3, 10_000])
def test_lattice_scores_match_brute_force(spark, head):
    texts = corpus(6) + ["Aa aa", "ÄÖ x"]
    docs = documents(spark, texts)
    found = {r["doc_id"]: r for r in lattice_lm.scored(docs, fold(7) != 2, head=head).collect()}
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    counts = collections.Counter()
    for t, k in zip(texts, train):
        if k:
            counts.update([*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*words(lower(t)), None]
        r = found[i]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (train[i], len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens))
        assert r["score"] < 0
    again = lattice_lm.scored(documents(spark, ["a b", "a b", None], [1, 1, None]), F.lit(True)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in again) == [(0, 1), (1, 3), (1, 3)]
    assert lattice_lm.scored(documents(spark, []), F.lit(True)).count() == 0


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a < b &amp; c</p>", "a < b & c"),
        ("<article><h1>T</h1><p><b>x<br>y<p>z</article><footer>f</footer>", "T\n\nx y\n\nz"),
        ("<nav><a href=/>home</a></nav><div class='ad'>buy</div><article><p>One,&nbsp; two</p><ul><li>i<li>j</ul></article><section id=comments><p>hi</p></section>", "One, two\n\ni\n\nj"),
        ("<body class=sidebar-left><main><p>k</p><form>f<input></form><aside>s</aside><script>var a='<p>no</p>'</script></main><div class='cookie-notice'>c</div>", "k"),
        ("<div><p>text, of the page, with commas, and more of it</p></div><div class=sidebar><p>s</p></div>", "text, of the page, with commas, and more of it"),
        ("<article><p>cut <a hr", "cut"),
        ("<article><p>a<!-- b --><style>p{}</style> c<script>x", "a c"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<div class='layout has-sidebar'><article><p>Main text, here</p></article></div>", "Main text, here"),
        ("<div class='site no-sidebar'><p>Main text, here</p><p>b</p></div>", "Main text, here\n\nb"),
        ("<div class='content share-enabled'><p>Main text, here</p></div><div class=share>tell</div>", "Main text, here"),
        ("<body><form id=f><div class=search>find</div><article><p>In a form</p></article></form>", "In a form"),
        ("<form><div><p>No article, in a form</p></div></form><p>x</p>", "No article, in a form"),
        ("<main><article><p>First</p></article></main><article><p>Second, and longer, with more commas</p></article>", "First\n\nSecond, and longer, with more commas"),
        ("<div id=comments><article><p>a long comment, with commas, longer than the text</p></article></div><article><p>x</p></article>", "x"),
        ("<p>a <span class=share>t</span> b, and more</p>", "a b, and more"),
        ("<article><div class=comment><p>no</p></div><p>yes</p><article class='comment'><p>no</p></article></article>", "yes"),
    ],
)
def test_html_main_text(page, text):
    assert html_main.main_text(page) == text


def test_html_main_text_of_made_pages():
    """Pages put together from an article and what surrounds it, in any order and nesting, against the article's own blocks."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    prose = lambda n: ", ".join(word() for _ in range(n))
    around = [
        lambda: f"<nav><ul><li><a href=/x>{prose(2)}</a><li><a href=/y>{word()}</a></ul></nav>",
        lambda: f"<div class='{rng.choice(['ad', 'sidebar', 'cookie-notice', 'share buttons', 'relatedPosts'])}'><p>{prose(rng.randint(1, 9))}</p></div>",
        lambda: f"<form action=/s>{word()}<input name=q></form>",
        lambda: f"<footer>&copy; {prose(3)}</footer>",
        lambda: f"<aside>{prose(4)}</aside>",
        lambda: f"<section id=comments><article class=comment><p>{prose(20)}</p></article></section>",
        lambda: f"<script>if (a < b) write('<p>{word()}</p>')</script><style>p {{}}</style><!-- <p>{word()}</p> -->",
        lambda: f"<div style='display: none'>{prose(5)}</div>",
    ]
    for _ in range(300):
        blocks, html_ = [], ""
        for _ in range(rng.randint(1, 6)):
            text, kind = prose(rng.randint(5, 40)), rng.choice(["p", "li", "h2", "bare", "entity"])
            if kind == "li":
                html_ += f"<ul><li>{text}</ul>"
            elif kind == "entity":
                html_ += f"<p>{text} &amp;\n\t<b>&lt;x&gt;</b><br>z"
                text += " & <x> z"
            elif kind == "bare":
                html_ += f"<div>{text}</div>"
            else:
                html_ += f"<{kind}>{text}</{kind}>"
            blocks.append(text)
            if rng.random() < 0.3:
                html_ += rng.choice(around)()
        html_ = f"<article>{html_}</article>"
        for _ in range(rng.randint(0, 3)):
            html_ = f"<div class='{rng.choice(['wrap', 'layout has-sidebar', 'no-ads page'])}'>{html_}</div>"
        before, after = ("".join(f() for f in rng.choices(around, k=rng.randint(0, 3))) for _ in range(2))
        assert html_main.main_text(f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{before}{html_}{after}</body></html>") == "\n\n".join(blocks)


def test_html_of_any_depth_is_read():
    assert html_main.main_text("<article>" + "<div>a, b" * 20_000) == "\n\n".join(["a, b"] * 20_000)
    assert html_main.main_text("<p>" + "x, " * 200_000) == ("x, " * 200_000).strip()


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", "old"), (None, None, None, None), (1, "u", "<p>é</p>", "old")], "page_id long, url string, html string, text string")
    assert multiset(html_main.extracted(pages).select("page_id", "url", "text", "n_chars").collect()) == {(1, "u", "é", 1): 2, (None, None, "", 0): 1}
    assert html_main.extracted(pages.limit(0)).count() == 0


# languages


def made(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(8)
    own = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["str", "en", "ung", "ich"], "cc": ["ção", "ño", "él", "ra"]}
    rows = [(i, made(rng, own[lang], rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choices(list(own), k=240))]
    model = langid.fitted(spark.createDataFrame(rows[:160], "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows[160:]] + [None, "", "123 -- !", "日本"]
    found = {r["doc_id"]: r for r in langid.identified(documents(spark, texts), model).collect()}
    right = [found[i]["lang_pred"] == rows[160 + i][2] for i in range(80)]
    assert np.mean(right) > 0.95
    assert [found[80 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert found[83]["lang_pred"] in own
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = langid.fitted(spark.createDataFrame([(1, None, "aa"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identified(documents(spark, ["abc"]), none).collect()} == {"und"}


def test_kneser_ney_sums_to_one(spark):
    rows = [(i, t, "aa") for i, t in enumerate(["banana bandana", "nab a ban", "cab"] * 4)]
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    total = 0.0
    for c in "abcdn ":
        hashes, place = langid.gram_hashes(["ban" + c])
        total += float(np.exp(model.models[0].log_probabilities(hashes, place)[4]))
    assert total == pytest.approx(1, abs=0.2)  # the rest is for characters never seen


# repeats


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("key"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("key"))
    found = {r["id"]: r["mark"] for r in sieve.joined(rows, keys.withColumn("mark", F.lit(1))).collect()}
    assert found == {i: 1 if i % 3 == 0 else None for i in range(3000)}
    assert sieve.joined(rows, keys.limit(0).withColumn("mark", F.lit(1))).where("mark is not null").count() == 0


@pytest.mark.parametrize("group", [2, 1 << 15])
@pytest.mark.parametrize("seed", [11, 12])
def test_repeats_match_brute_force(spark, group, seed, monkeypatch):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (group,))
    texts = corpus(seed)
    ids = [*range(len(texts) - 2), 0, None]
    docs = documents(spark, texts, ids)
    want = removal([(t or "").encode() for t in texts], 40, bytes)
    found = suffix_array.deduplicated(docs, window=40, run=7).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert multiset(found.collect()) == multiset((i, *w) for i, w in zip(ids, want))
    want = removal([[w.encode() for w in words(t)] for t in texts], 9, b" ".join)
    found = suffix_tree.deduplicated(docs, window=9, run=3).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert multiset(found.collect()) == multiset((i, w[0], w[1], w[3]) for i, w in zip(ids, want))


@pytest.mark.parametrize("group", [2, 1 << 15])
def test_repeat_groups_hold_all_occurrences(spark, group, monkeypatch):
    window = 40
    monkeypatch.setattr(repeats.repeat_groups, "__defaults__", (group,))
    texts = [t for t in corpus(13) if t]
    data = [t.encode() for t in texts]
    found = collections.defaultdict(list)
    for r in suffix_array.repeats(documents(spark, texts), window=window, run=7).collect():
        found[r["repeat"], r["length"]].append((r["doc_id"], r["place"]))
    where = collections.defaultdict(list)
    for k, d in enumerate(data):
        for i in range(len(d) - window + 1):
            where[d[i : i + window]].append((k, i))
    inside, contents = [[False] * len(d) for d in data], set()
    for (_, n), places in found.items():
        k, i = places[0]
        held = data[k][i : i + n]
        contents.add(held)
        assert sorted(places) == [(k, i) for k, i in where[held[:window]] if data[k][i : i + n] == held]
        assert len(places) > 1 and n >= window
        for k, i in places:
            inside[k][i : i + n] = [True] * n
    assert len(contents) == len(found)
    assert inside == covered(data, window)
    for held, places in where.items():
        around = [{data[k][j] if 0 <= j < len(data[k]) else (k, i) for k, i in places for j in [i + step]} for step in (-1, window)]
        if len(places) > 1 and all(len(x) > 1 for x in around):
            assert held in contents
    assert suffix_array.repeats(documents(spark, [])).count() == 0


def test_repeats_leave_unique_text_alone(spark):
    texts = [" ".join(f"u{k}x{i}" for i in range(100)) for k in range(5)] + ["a\tb\n"]
    found = suffix_tree.deduplicated(documents(spark, texts), keep=("lang", "n_chars")).collect()
    assert {r["doc_id"]: r["text"] for r in found} == dict(enumerate(texts))
    assert suffix_array.deduplicated(documents(spark, [])).count() == 0


# mixing


def test_mixing(spark):
    rng = random.Random(9)
    texts = [" ".join(["w"] * rng.randint(0, 300)) for _ in range(300)] + [None, ""]
    docs = documents(spark, texts, [*range(300), None, 5])
    for shard_words in (1 << 23, 5000):
        found = mixing.mixed(docs, shard_words=shard_words).collect()
        assert len(found) == len(texts)
        assert all(r["taken"] <= 3 * r["size"] for r in found)
        by = collections.defaultdict(lambda: [0, 0, 0.0])
        for r in found:
            by[r["source"]][0] += r["size"]
            by[r["source"]][1] += r["taken"]
            by[r["source"]][2] = r["target"]
        total = sum(s for s, _, _ in by.values())
        order = [s for s in ("s1", "s2", None)]
        for s, weight in zip(order, (5, 2, 1)):
            assert by[s][2] == pytest.approx(total * weight / 8, abs=1e-3)
            assert abs(by[s][1] - by[s][2]) <= 64
        assert multiset(found) == multiset(mixing.mixed(docs, shard_words=shard_words).collect())
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_sainte_lague(spark):
    votes = [53, 24, 23, 0, 1000]
    for seats in (0, 1, 7, 10, 101):
        parties = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "p int, votes double, seats long")
        found = {r["p"]: r["quota"] for r in mixing.apportioned(parties, [], "p", "votes", "seats").collect()}
        best = sorted(((-v / (2 * s + 1), i) for i, v in enumerate(votes) if v for s in range(seats)))[:seats]
        count = collections.Counter(i for _, i in best)
        assert found == {i: count[i] for i in range(len(votes))}


def test_targets_above_three_times_the_source_are_shared_again(spark):
    docs = documents(spark, ["w"] * 3 + ["w " * 400] * 3)
    rows = spark.createDataFrame([("a", 10.0), ("b", 900.0), ("c", 90.0)], "source string, source_size double").withColumn("source_key", F.col("source"))
    found = {r["source_key"]: r["target"] for r in mixing.targets(rows, 1000, (5, 2, 1), 3).collect()}
    assert found == {"a": 30.0, "b": pytest.approx(700.0), "c": 270.0} and docs.count() == 6


# toxicity


def test_nearest_examples_are_exact():
    rng = random.Random(10)
    idf = np.array([1 + rng.random() for _ in range(40)])
    examples = [(i, rng.randint(0, 1), {rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}) for i in range(500)]
    index = toxicity.Index(idf, examples, 10)
    unit = {e[0]: dict(index.unit(e[2])) for e in examples}
    for _ in range(60):
        query = {rng.randrange(40): rng.randint(1, 2) for _ in range(5)}
        places, scores = index.near(query)
        own = dict(index.unit(query))
        want = sorted((sum(w * unit[i].get(t, 0) for t, w in own.items()) for i in unit), reverse=True)[:10]
        assert np.allclose(scores, [w for w in want if w > 0])
        assert np.allclose([sum(w * unit[int(index.ids[p])].get(t, 0) for t, w in own.items()) for p in places], scores)


def test_toxicity(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.2
        text = made(rng, ["ka", "lo", "mi", "tu", "str"], 30) + (" " + rng.choice(["vileword", "badnessly", "badnesses"]) if toxic else "")
        rows.append(text)
        labels.append((i, int(toxic)))
    labels += [(3, 1), (None, 1), (5, None)]
    docs = documents(spark, rows + [None, ""])
    tags = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(docs, tags, folds=5)
    found = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0 and i not in (3,)]
    assert np.mean([found[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert found[400]["predicted"] == found[401]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.clean(docs, model).collect()} == {i for i, r in found.items() if not r["predicted"]}
    nothing = toxicity.fitted(docs, tags.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, nothing).collect()} == {0.0}


# decontamination


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(12)
    vocab = [f"b{i}" for i in range(12)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(1, 80))] for _ in range(25)]
    texts = []
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, len(item) // 4 + 1)):
            at = rng.randrange(len(item) + 1)
            item[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        texts.append(", ".join(t[:20] + item + t[20:]).upper())
    texts += [None, "", texts[0]]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if len(item) >= 5:
                distance = edit_search(item, decontam.tokens(t))
                if distance <= int(0.2 * len(item)):
                    want[d, i] = distance
    for block in (7, 1000):
        found = decontam.matches(documents(spark, texts), bench, block_items=block).collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in found} == want
    left = decontam.clean(documents(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.matches(documents(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_tells_rows_without_or_with_shared_ids_apart(spark):
    item = " ".join(f"q{i}" for i in range(20))
    texts = [f"a {item}", "b c d", "e f", f"g {item}", "h i", None]
    docs, bench = documents(spark, texts, [None, None, 3, 3, 3, None]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert multiset((r["doc_id"], r["text"]) for r in decontam.clean(docs, bench).collect()) == multiset([(None, "b c d"), (3, "e f"), (3, "h i"), (None, None)])
