import random
from collections import Counter

import xxhash

from feltloom.llm.simhash import components, fingerprint, links, near_duplicates

from helpers import SCHEMA, make_documents


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {p: find(p) for p in prints}


def test_near_duplicates(spark):
    frame, rows = make_documents(spark)
    got = near_duplicates(frame).collect()
    prints = {id(r): plain_fingerprint(r[1]) for r in rows}
    roots = brute_components(set(prints.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            root = roots[prints[id(r)]]
            least[root] = min(least.get(root, r[0]), r[0])
    expected = Counter((r[0], f"{prints[id(r)]:016x}", least.get(roots[prints[id(r)]])) for r in rows)
    assert Counter(map(tuple, got)) == expected


def test_fingerprint_of_long_text_and_spark_hash(spark):
    text = " ".join(random.Random(1).choices(["Alpha", "beta", "été"], k=3000))
    assert fingerprint(text) % 2**64 == plain_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_links_and_components_match_brute_force(spark):
    draw = random.Random(3)
    prints = set()
    for _ in range(15):
        at = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 12])):
            prints.add(at - (1 << 64) if at >> 63 else at)
            at ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))  # chains: the ends may be far apart
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.root for r in components(links(frame)).collect()}
    expected = brute_components(prints)
    assert {p: found.get(p, p) for p in prints} == expected


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
