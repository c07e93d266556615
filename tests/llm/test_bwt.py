import random
from collections import defaultdict

from quirework.llm import bwt


def test_merge_finds_all_repeats():
    rng = random.Random(1)
    for depth in (1, 3, 6):
        shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(6)] for _ in range(2)]
        expected = defaultdict(lambda: (set(), set()))
        for k, texts in enumerate(shards):
            base = 0
            for t in texts:
                for j in range(len(t) - depth + 1):
                    expected[t[j : j + depth]][k].add(base + j)
                base += len(t) + 1
        expected = sorted((sorted(x), sorted(y)) for x, y in expected.values() if len(x) + len(y) > 1)
        got = bwt.repeated(bwt.transform(shards[0]), bwt.transform(shards[1]), depth)
        assert sorted((sorted(x.tolist()), sorted(y.tolist())) for x, y in got) == expected
