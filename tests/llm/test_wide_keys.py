"""The keys of wide fingerprints: right, and by a plan that stays small in the driver."""

from tessera.llm import simhash


def test_wide_keys_are_pairs_of_bytes_by_a_small_plan(spark):
    fps = [[(i * 0x9E3779B97F4A7C15 + k * 0xD1342543DE82EF95) % (1 << 64) - (1 << 63) for k in range(8)] for i in range(3)]
    found = simhash.wide_keys(spark.createDataFrame(list(enumerate(fps)), "node long, fp array<long>"), 512)
    want = set()
    for node, fp in enumerate(fps):
        held = [fp[b // 8] >> 8 * (b % 8) & 255 for b in range(64)]
        pairs = [(a, a ^ step) for step in simhash.PARTNERS for a in range(64) if a < a ^ step]
        want |= {((held[a] * 256 + held[b]) * len(pairs) + s, node, tuple(fp[:4])) for s, (a, b) in enumerate(pairs)}
    rows = [(r["key"], r["node"], tuple(r["fp"])) for r in found.collect()]
    assert len(rows) == len(want) == 3 * 96 and set(rows) == want
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 4000  # an expression for each pair makes it longer
