"""Synthetic documents: the same rows however they are dealt out, and what their labels and lines promise."""

import numpy as np

from wordloom.operators import synthetic


def test_rows_do_not_depend_on_partitions(spark):
    sents = [(k, [f"{'ကခဂဃ'[k % 4]}{j}" for j in range(2 + k % 7)]) for k in range(40)]
    s = synthetic.Layout(header=0.5)
    rows = []
    for parts in (1, 8):
        source = spark.createDataFrame(sents, "id long, tokens array<string>").repartition(parts)
        junk = spark.createDataFrame([(x,) for x in "#/*="], "token string").repartition(parts)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows.append({r.doc: (r.tokens, r.gaps, r.labels) for r in synthetic.documents(60, source, junk, "က-႟", s=s, seed=5).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] and set(rows[0]) == set(range(60))
    words = {t for _, ts in sents for t in ts}
    seen = {"O": 0, "SENT_END": 0, "PARA_END": 0}
    for tokens, gaps, labels in rows[0].values():
        assert len(tokens) == len(gaps) == len(labels) + 1 and gaps[-1] == "\n"
        for t, g, y in zip(tokens, gaps, labels):
            seen[y] += 1
            assert y != "PARA_END" or g == "\n"
            assert y != "SENT_END" or t in words or t[:-1] in words
        paras, begin = [], 0
        for i, y in enumerate([*labels, "PARA_END"]):
            if y == "PARA_END":
                paras.append((tokens[begin : i + 1], gaps[begin : i + 1]))
                begin = i + 1
        for ts, gs in paras:
            if ts[-1] == ")":
                assert ts[0].endswith("#") and ts[3] == "(" and "\n" not in gs[:-1]
                continue
            script = [int("က" <= t[0] <= "႟" and t not in "၊။") or int(t in "၊။") for t in ts]
            lines, count = [], 0
            for c, g in zip(script, gs):
                count += c
                if g == "\n":
                    lines.append(count)
                    count = 0
            assert max(lines[:-1], default=0) <= s.line + 1
    assert min(seen.values()) > 50
    empty = spark.createDataFrame([], "id long, tokens array<string>")
    assert synthetic.documents(5, empty, spark.createDataFrame([("x",)], "token string"), "က-႟").count() == 0


def line_ends_slow(counts, widths, short):
    """Token by token."""
    out, at = [], 0
    while at < len(counts) and sum(counts[at:]) > short:
        end, have = at, counts[at]
        while end < len(counts) - 1 and have < max(2, widths(len(out))):
            end += 1
            have += counts[end]
        while end > at and sum(counts[end + 1 :]) <= short:
            end -= 1
        out.append(end)
        at = end + 1
    return out


def test_line_ends_equal_a_walk():
    r = np.random.default_rng(2)
    for _ in range(500):
        counts = r.integers(0, 2, int(r.integers(0, 40)))
        short, base = int(r.integers(0, 5)), int(r.integers(1, 9))
        widths = lambda line: base + line % 3 - 1  # noqa: B023, E731
        assert synthetic.line_ends(counts, widths, short) == line_ends_slow(counts.tolist(), widths, short)
