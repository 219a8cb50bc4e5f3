"""Terms of texts: those of the pattern, found in a fraction of its time."""

import random
import time

from tessera.llm import toxicity


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(8)
    latin = [chr(i) for i in range(256)]
    texts = ["".join(latin), "".join(f"a{c}B" for c in latin), "STRASSE straße ÀÉ_x9y µm² ½ºª", "Ωσς ΑΣ", "İI ŒÆ ÿŸ", "日本 ab1c", None, "", " \x85\xa0\x1c"]
    texts += ["".join(rng.choices(latin, k=200)) for _ in range(50)] + ["".join(chr(rng.randint(0, 0x2FF)) for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert toxicity.tokens(t) == toxicity.TOKEN.findall((t or "").lower())


def test_distinct_terms_are_those_counted():
    counted = toxicity.Counted({"known": 3, "know*": 1, "a": 0, "unkn*": 4, "longest": 2})
    for t in ("known knows A a longest unknown", "knowing", "none", "", None, "unkn", "KNOWN known"):
        terms, times = counted(t)
        assert sorted(counted.distinct(t).tolist()) == terms.tolist() and len(times) == len(terms)
    assert [x.tolist() for x in counted("known Knows known a unknown longer")] == [[0, 1, 3, 4], [1, 3, 2, 1]]


def test_tokens_take_a_fraction_of_the_patterns_time():
    text = " ".join(f"wörd{chr(97 + i % 26)}, Über" for i in range(20_000))

    def least(run):
        times = []
        for _ in range(5):
            start = time.process_time()
            run(text)
            times.append(time.process_time() - start)
        return min(times)

    assert least(toxicity.tokens) < 0.5 * least(lambda t: toxicity.TOKEN.findall(t.lower()))
