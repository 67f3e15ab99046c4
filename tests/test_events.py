import math
import random

import pytest

from strandflow.operators.models import AdaptiveBit
from strandflow.plans import events


def test_adaptive_bits_of_long_users(spark):
    rng = random.Random(5)
    rows = [(i, u, i, "purchase" if rng.random() < (0.1 if i < 4000 else 0.8) else rng.choice(["click", None])) for i, u in
            enumerate([7] * 5000 + [8] * 121 + [9] * 122 + [None] * 300 + [10])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").repartition(3)
    got = {r.user_id: (r.symbols, r.ones, r.bits) for r in events.bit_costs(df).collect()}
    want = {}
    for user in (7, 8, 9, None, 10):
        model, n, ones, bits = AdaptiveBit(), 0, 0, 0.0
        for *_, kind in sorted(r for r in rows if r[1] == user):
            bit = int(kind == "purchase")
            bits -= math.log2(model.p if bit else 1 - model.p)
            model.update(bit)
            n, ones = n + 1, ones + bit
        want[user] = (n, ones, pytest.approx(bits, abs=1e-5))
    assert want[7][0] == 5000 and got == want
