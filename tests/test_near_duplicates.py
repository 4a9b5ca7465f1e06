"""Near copies of reviews: the same survivors as by all pairs in order, and no place in one group."""

import random
import re
from datetime import datetime

from lodestar.operators import reviews


def _greedy(rows):
    """Survivors of one place, pair by pair."""
    rows = sorted(rows)
    if len(rows) < 15:
        return {r[0] for r in rows}
    tokens = [{w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) > 2} for _, t, _ in rows]
    gone = {i for i, t in enumerate(tokens) if not t}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if i in gone:
                break
            a, b = rows[i], rows[j]
            if j in gone or min(len(a[1]), len(b[1])) / max(len(a[1]), len(b[1])) < 0.5 or len(tokens[i] & tokens[j]) / len(tokens[i] | tokens[j]) < 0.85:
                continue
            first = a[2] >= b[2] if a[2] and b[2] else a[2] is not None if a[2] or b[2] else len(a[1]) >= len(b[1])
            gone.add(j if first else i)
    return {r[0] for i, r in enumerate(rows) if i not in gone}


def test_survivors_are_those_of_all_pairs(spark):
    deal, rows = random.Random(5), []
    for place in (1, 2, None):
        for i in range(120):
            base = random.Random(deal.randrange(9) + 100 * (place or 0))
            words = [f"w{base.randrange(60):02}é" for _ in range(base.choice([1, 4, 9, 25]))]
            for _ in range(deal.randrange(3)):
                words[deal.randrange(len(words))] = f"x{deal.randrange(4)}²"
            text = " ".join(words) + "!" * deal.choice([0, 3, 90])
            rows.append((place, i, deal.choice([text, text, text, text, "", None][: 6 if i % 9 == 0 else 4]), deal.choice([None, datetime(2024, 1, 1 + deal.randrange(3))])))
    rows += [(7, i, "same words here", None) for i in range(14)]
    df = spark.createDataFrame(rows, "spot_id long, review_id long, text string, at timestamp")
    out = reviews.drop_near_duplicates(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # no place as one group
    got = {(r.spot_id, r.review_id) for r in out.collect()}
    want = {(p, i) for p in (1, 2, None, 7) for i in _greedy([r[1:] for r in rows if r[0] == p])}
    assert got == want and len(got) < len(rows) - 60
