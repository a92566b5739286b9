"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorewell.llm import bpe, common, components, exact_dedup, graph_search, language_id, licenses, packing, sharding, simhash, substring_dedup, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blk long, key string, part int"
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def texts() -> list[tuple]:
    """Rows (id, text): copies, near copies, shared passages, long and empty texts, nulls, repeated rows and ids."""
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(50), prose(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, base), (7, base), (8, " ".join(near)), (9, base.upper()),
        (10, prose(40) + " " + passage + " " + prose(20)), (11, passage), (12, prose(10) + "\n" + passage.replace(" ", "  ")), (13, "x" * 9000),
        (14, prose(5000)), (15, "a " * 200), (16, "é ü 日本語 ́ <|endoftext|> İ don't"), (17, "two words"), (17, "two words"), (18, "All rights reserved. Licensed under CC BY-NC 4.0."),
        (None, "two words"), (None, None), (19, passage + " " + passage), (20, "12 34 !?"), (21, "!!!"), (-5, "negative"),
    ]
    return rows + [(100 + i, base) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 3 else "en", None, n, n, "k", None) for n, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [tuple(r) for r in df.collect()]


def key(x):
    return (x is not None, x) if not isinstance(x, tuple) else tuple(key(y) for y in x)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    want = []
    for i, t in texts():
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    for least in (500, 3):  # with and without salted groups
        assert sorted(collected(exact_dedup.exact_dedup(docs, salts=4, least_hot=least)), key=key) == sorted(want, key=key)
        kept = collected(exact_dedup.drop_copies(docs, salts=4, least_hot=least).select("doc_id", "text"))
        assert len(kept) == len(groups) and {t or "" for _, t in kept} == set(groups)
        assert {t or "": i for i, t in kept} == {t: max((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    assert exact_dedup.exact_dedup(empty).count() == 0 == exact_dedup.drop_copies(empty).count()
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def jump(k, n):
    """The published loop."""
    b, j = -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_function(spark):
    keys = [0, 1, -1, 42, (1 << 63) - 1, -(1 << 63), 0x123456789ABCDEF]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 100, 10_000, 1_000_000):
        got = dict(collected(df.select("k", sharding.jump_shard(F.col("k"), n))))
        assert got == {k: jump(k % (1 << 64), n) for k in keys}


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, 6, bucket_rows=3).collect()
    assert len(rows) == len(texts())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 6)
        if r.doc_id is not None:
            k = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)
            assert (r.shard, r.grown_shard) == (jump(k, 6), jump(k, 7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.assign_shards(empty).count() == 0


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, f"file://{tmp_path}/s", 5)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == len(texts())
    assert back.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_bpe_equals_the_library(path):
    engine, library, undo = bpe.engine(path), Tokenizer.from_file(path), bpe.decoder(path)
    random.seed(2)
    cases = [t or "" for _, t in texts()]
    cases += ["".join(random.choice("abc dé!'1\n") for _ in range(400)) for _ in range(50)]
    cases += ["'s don't we'll <|endoftext|>x<|startoftext|>", "q" * 5000 + " " + "ab" * 4000 + "!" * 5000, "".join(random.choice("thneaios") for _ in range(30000))]
    for t in cases:
        want = library.encode(t, add_special_tokens=False).ids
        assert engine.encode(t).tolist() == want
        assert undo(np.array(want, np.uint32)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_pieces_of_other_scripts_are_concatenated(path, monkeypatch):
    engine, library, calls = bpe.engine(path), Tokenizer.from_file(path), []
    whole = engine.concatenated
    monkeypatch.setattr(engine, "concatenated", lambda data, *leaf: calls.append(len(data)) or whole(data, *leaf))
    random.seed(8)
    for letters in ("αβγδεζηθΑΒΣς", "абвгдежзЙЁ", "日本語中文字漢", "😀😁🎉", "e\u0301a\u0308\u1100\u1161İ"):
        run = "".join(random.choice(letters) for _ in range(6000))
        t = f"don't {run}<|endoftext|> {run[:50]}  1234\n{run[::-1]} x"
        assert engine.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
        if letters[0] in "αа日😀":
            assert max(calls) > bpe.LONG_PIECE
        calls.clear()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_concatenation_is_exact(path):
    """Small leaves force many joins; the whole piece encoded at once is the truth."""
    engine = bpe.engine(path)
    random.seed(3)
    for alphabet in ("ab", "thneaiosrd", "x"):
        for n in (1, 7, 50, 700):
            data = "".join(random.choice(alphabet) for _ in range(n)).encode() + (b" " if path == WORD else b"")
            for leaf in (2, 5, 16):
                assert engine.concatenated(data, leaf) == engine.piece(data)


def test_codec_rows(docs, empty):
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(collected(tokens.token_digests(docs, WORD)), key=key) == sorted(want, key=key)
    whole = tokens.encode_texts(docs, WORD)
    assert {r.decoded for r in tokens.decode_ids(whole, WORD).collect()} == {r.decoded for r in whole.collect()}
    assert tokens.token_digests(empty, WORD).count() == 0


def test_packing(docs, empty):
    library = Tokenizer.from_file(BYTE)
    for length in (16, 1024):
        pieces = packing.pack(docs, BYTE, length, with_ids=True)
        rows = pieces.collect()
        want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in texts())
        by_sequence, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
            by_sequence[r.sequence_id].append((r.offset, r.length))
            by_doc[r.sequence_id * length + r.offset - r.start].append((r.start, ids, r.doc_tokens))
        for s, spans in by_sequence.items():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at == length or s == max(by_sequence)
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        got = Counter()
        for parts in by_doc.values():
            parts.sort(key=lambda p: p[0])
            whole = np.concatenate([p[1] for p in parts])
            assert len(whole) == parts[0][2]
            got[tuple(whole.tolist())] += 1
        assert got == want
        for r in packing.sequences(pieces, length).collect():
            assert len(r.ids) == r.n_ids + r.padding and (r.n_ids + r.padding == length or r.n_ids & (r.n_ids - 1) == 0)
    assert packing.pack(empty, BYTE).count() == 0


def test_token_files(docs, empty):
    library = Tokenizer.from_file(WORD)
    rows = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts()), key=lambda r: key(r[0]))
    total = sum(len(ids) for _, ids in rows)
    got = sorted(token_files.token_files(docs, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == total
    assert token_files.token_files(empty, WORD).count() == 0


def test_token_files_in_many_shards_and_by_key(spark, docs, tmp_path):
    """Files cut by size, an id with many rows over several tasks, and the smallest of all ids, which is no null."""
    rows = [*texts(), (-(1 << 63), "least"), *[(7777, f"text {i % 4} of one id") for i in range(200)], *[(None, "no id")] * 30]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    listed = token_files.write_token_files(df, f"file://{tmp_path}/t", WORD, shard_bytes=2000, task_bytes=4000)
    assert listed.count() > listed.select("part").distinct().count() > 3
    library = Tokenizer.from_file(WORD)
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    found, places = defaultdict(list), Counter()
    for r in listed.collect():
        shard = token_files.Shard(r.uri)
        for k in wanted:
            if ids := shard.get(k):
                places[k] += 1
                found[k] += [x.tolist() for x in ids]
        assert shard.get(987654321) == []
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert places[7777] > 1
    back = token_files.read_token_files(listed).orderBy("start").collect()
    assert [r.doc_id for r in back] == sorted((i for i, _ in rows), key=key)
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back]).tolist()[:-1]]


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 20000):
        keys = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
        keys = np.unique(keys)
        h = token_files.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(200)] + [(999, None)], "i int, k string")
    single = rows.groupBy("k").agg(F.max("i").alias("m"))
    assert common.hot_keys(rows, "k", 10) == ["a"] and common.hot_keys(rows, "k") == []
    for how in ("inner", "left"):
        want = Counter(collected(rows.join(single, "k", how).select("i", "k", "m")))
        assert Counter(collected(common.spread_join(rows, single, "k", how, hot=["a"]).select("i", "k", "m"))) == want


def fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    fps = [(i, fingerprint(t, 3)) for i, t in texts()]
    root = reach({f for _, f in fps}, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=key)
    assert sorted(collected(simhash.near_groups(docs)), key=key) == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("slice_rows", [2000, 20])
def test_near_copies_around_one_boilerplate(spark, monkeypatch, slice_rows):
    """Hundreds of documents share a passage, most of them unrelated otherwise; some have a near copy, and those with
    little text of their own are alike by the passage alone. With small slices the passage's hashes count as hot."""
    monkeypatch.setattr(simhash, "SLICE", slice_rows)
    monkeypatch.setattr(simhash, "HUB", slice_rows)
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    passage, rows = [word() for _ in range(200)], []
    for n in range(320):
        own = [word() for _ in range(random.randint(14, 30) if n % 8 == 0 else random.randint(40, 60))]
        rows.append((len(rows), " ".join(passage + own)))
        if n % 8 == 1:
            own[20] = word()
            rows.append((len(rows), " ".join(passage + own)))
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = reach(list(sets), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == sorted(i for i in sets if root[i] == i)


def test_near_copies_of_random_sets(spark):
    """Short texts over few words: all similarities occur, ties at 0.8 too, and prefixes share many hashes."""
    random.seed(14)
    rows = [(i, " ".join(random.choice("abc") for _ in range(random.randint(1, 30)))) for i in range(250)]
    for _ in range(250):
        w = random.choice(rows)[1].split()
        w[random.randrange(len(w) + 1) :] = random.choices("abc", k=random.randint(0, 3))
        rows.append((len(rows), " ".join(w)))
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = reach([i for i in sets if sets[i]], lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in sets if root.get(i, i) == i)


def test_near_copies_with_another_repeated_line(spark):
    """One line that stands many times and differs sets the fingerprint of all shingles, not the similarity."""
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(40):
        own = " ".join(word() for _ in range(190))
        for _ in range(2):
            rows.append((len(rows), own + (" " + " ".join(word() for _ in range(8))) * 80))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    assert all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, len(rows), 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == list(range(0, len(rows), 2))


@pytest.mark.parametrize("hot_key", [2000, 3])
def test_simhash_links_connect_what_brute_force_does(spark, hot_key):
    """Clusters of close fingerprints, found as pairs and by bridging values."""
    random.seed(hot_key)
    base = [random.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for _ in range(random.randint(1, 5)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = collected(simhash.links(df, 3, hot_key))
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in found)
    want = reach({signed(x) for x in fps}, lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 3)
    pairs = set(found) | {(b, a) for a, b in found}
    assert reach({signed(x) for x in fps}, lambda a, b: (a, b) in pairs) == want


def test_components_in_many_tasks(spark):
    random.seed(1)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    adjacent = set(edges) | {(b, a) for a, b in edges}
    want = {n: r for n, r in reach({x for e in edges for x in e}, lambda a, b: (a, b) in adjacent).items() if n != r}
    for task_links in (200_000, 20):
        assert dict(collected(components.components(df, task_links))) == want


def test_near_copies_by_similarity(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    rows, shingles = [], {}
    for g in range(12):
        base = [word() for _ in range(150)]
        for c in range(5):
            w = base.copy()
            for _ in range(c if g % 2 else 4 * c):
                w[random.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "short one"), (903, "short one"), (None, "short one")]
    for i, t in rows:
        w = (t or "").split()
        shingles[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()

    def alike(a, b):
        union = shingles[a] | shingles[b]
        return bool(union) and len(shingles[a] & shingles[b]) / len(union) >= 0.8

    numbered = [i for i, _ in rows if i is not None]
    root = reach(numbered, alike)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, key string")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in numbered if root[i] == i)
    named = simhash.drop_near_copies(df.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id") + 100)))
    assert named.count() == len({root[i] for i in numbered})
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def removal(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [35, 4, 7])
def test_substring_dedup(docs, empty, size):
    got = substring_dedup.remove_repeats(docs, size)
    assert sorted(collected(got), key=key) == sorted(removal(texts(), size), key=key)
    assert substring_dedup.remove_repeats(empty, size).count() == 0


def test_substring_dedup_keeps_text_and_columns(spark):
    rows = [(i, t, "s", n, n) for n, (i, t) in enumerate(texts())]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, _id int, n_words int")
    kept = substring_dedup.drop_repeats(odd, 35, chars_col="n_words")
    assert kept.columns == odd.columns
    # row numbers in _id tell repeated rows apart
    want = {n: r for (_, _, _, n, _), r in zip(rows, removal(texts(), 35), strict=True)}
    got = {r["_id"]: r for r in kept.collect()}
    assert set(got) == {n for n, r in want.items() if not r[2] or r[2] < r[1]}
    for n, r in got.items():
        assert r.n_removed == "s" and r.doc_id == rows[n][0]
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest() == want[n][3]
        assert r.n_words == (len(r.text) if want[n][2] else n)
        assert want[n][2] or r.text == rows[n][1]


#: Two words that a sum of byte values times place factors gave one 64-bit hash.
COLLIDING = "hbdaehcdgghcdeee", "beaababgfdbfgghf"


def test_substring_dedup_compares_words(spark, monkeypatch):
    """Windows with equal hashes and different words do not repeat."""
    random.seed(12)
    rest = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(34)]
    rows = [(i, " ".join([*rest[:17], w, *rest[17:]])) for i, w in enumerate(COLLIDING)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(collected(substring_dedup.remove_repeats(df))) == sorted(removal(rows, 35))
    # the last level alone, with a hash that tells nothing apart: words are numbered, 0 0 1 0 0 2 0 0 1 ...
    ids = np.array([0, 0, 1, 0, 0, 2, 0, 0, 1, 3, 0, 2, 0, 0], np.int32)
    starts = np.arange(len(ids) - 3)
    want = [Counter(tuple(ids[i : i + 4]) for i in starts)[tuple(ids[s : s + 4])] > 1 for s in starts]
    assert substring_dedup._equal_windows(ids, starts, 4).tolist() == want
    monkeypatch.setattr(substring_dedup, "mix64", lambda x: x * np.uint64(0))
    assert substring_dedup._equal_windows(ids, starts, 4).tolist() == want


def test_substring_dedup_whatever_the_order_of_a_blocks_rows():
    """What a block sends, and so what an answer's bits stand for, does not depend on the order its rows come in."""
    rows, levels, sent = [t or "" for _, t in texts()], substring_dedup._Levels(7), []
    for some in (rows, rows[::-1], rows[9:] + rows[:9]):
        w = substring_dedup.Words(pa.chunked_array([pa.array(some)]))
        table = substring_dedup._Stretches(8, levels, w, levels.full_places(w)).sent(0)
        sent.append({r["bucket"]: (r["body"], r["many"]) for r in table.to_pylist()})
    assert len(sent[0]) > 1 and sent[0] == sent[1] == sent[2]


def test_licenses(docs, empty):
    want = []
    for i, t in texts():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licenses.scan_licenses(docs)
    assert sorted(collected(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")), key=key) == sorted(want, key=key)
    assert {r.labels for r in got.where("doc_id = 18").collect()} == {"cc-by,cc-by-nc,reserved"}
    assert licenses.scan_licenses(empty).count() == 0


def by_every_block(text, templates, threshold):
    """Label -> best containment, over all blocks of all sizes."""
    words, found = licenses.words_of(text or ""), {}
    for label, template in templates:
        own = licenses.words_of(template)
        tokens, size = set(licenses.tokens_of(own)), 1 << (len(own) - 1).bit_length()
        for b in range(0, max(1, len(words)), size):
            share = len(tokens & set(licenses.tokens_of(words[b : b + 2 * size]))) / len(tokens)
            if share >= threshold - 1e-9:
                found[label] = max(found.get(label, 0.0), share)
    return found


@pytest.mark.parametrize("threshold", [0.6, 0.9, 1.0])
def test_license_join_misses_no_block(spark, threshold):
    """Labels and scores of whole texts against all blocks: templates of all sizes, whole, cut, changed and moved."""
    random.seed(4)
    few = [f"w{i}" for i in range(12)]
    templates = [(f"t{i}", " ".join(random.choices(few, k=random.randint(2, 40)))) for i in range(12)] + list(licenses.TEMPLATES)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(random.randint(0, 3)):
            w = random.choice(templates)[1].split()
            for _ in range(random.choice([0, 0, 1, len(w) // 10, len(w) // 3])):
                w[random.randrange(len(w))] = random.choice(["other", "w3", ""])
            parts += random.choices(few + ["x", "y"], k=random.randint(0, 60)) + w
        rows.append((i, " ".join(parts)))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates, threshold=threshold).collect()
    assert len(got) == len(rows)
    texts_by_id = dict(rows)
    for r in got:
        want = by_every_block(texts_by_id[r.doc_id], templates, threshold)
        assert r.labels == ",".join(sorted({*want, *filter(None, r.base_labels.split(","))}))
        assert r.score == pytest.approx(1.0 if r.n_base else max(want.values(), default=0.0))
    assert any(r.score not in (0, 1) for r in got) or threshold == 1.0


def test_license_texts_are_found_in_order_only(spark, tmp_path):
    mit = dict(licenses.TEMPLATES)["mit"]
    mixed = mit.split()
    random.seed(2)
    random.shuffle(mixed)
    rows = [(1, f"Copyright (c) 2020\n\n{mit.lower()}\nimport os"), (2, " ".join(mixed)), (3, mit.replace("NONINFRINGEMENT", "SOMETHING"))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[2].labels == "" and got[3].labels == "mit" and 0.9 <= got[3].score < 1
    (tmp_path / "own.txt").write_text("this text may be used by our friends")
    (tmp_path / "other.v2.txt").write_text("all is free")
    assert [x for x, _ in licenses.read_templates(spark, f"file://{tmp_path}")] == ["other", "own"]


def test_language_id(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = language_id.language_id(docs).collect()
    assert len(odd) == len(texts())
    und = {r.doc_id for r in odd if r.lang_pred == "und"}
    assert {1, 2, 3, 20, 21} <= und and 4 not in und
    assert language_id.language_id(empty).count() == 0
    unlabelled = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_filters_by_brute_force(monkeypatch):
    """Masks against sets: no false negatives, and slicing of a long text changes nothing."""
    grams = {lang: np.unique(np.concatenate([h for _, h in language_id.gram_hashes(language_id.letters(t))])) for lang, t in (("aa", "the quick brown fox"), ("bb", "der schnelle braune fuchs"), ("cc", "le rapide renard brun"))}
    f = language_id.Filters(grams, rows=1 << 12)
    for i, lang in enumerate(f.languages):
        c = f.counts(np.zeros(len(grams[lang]), np.int64), grams[lang], 1)[0]
        assert c[0] == c[1 + i] == len(grams[lang])
    long = "the quick brown fox " * 500
    whole = f.predict([long, None, "", "123", "fuchs"])
    monkeypatch.setattr(language_id, "SLICE", 100)
    assert f.predict([long, None, "", "123", "fuchs"]) == whole
    assert [x for x, _ in whole] == ["aa", "und", "und", "und", "bb"]


def test_language_decisions_by_brute_force(spark):
    """Predictions of a whole table: every n-gram looked up in every language's filter on its own, and in plain sets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = language_id.learn(docs.where(~language_id.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, filters).collect()}
    rows, n_sets = docs.select("doc_id", "text", "lang").collect(), 0
    labelled = [r for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    often = {lang: Counter() for lang in filters.languages}
    for r in labelled:
        for _, h in language_id.gram_hashes(language_id.letters(r.text)):
            often[r.lang].update(h.tolist())
    exact = {lang: {h for h, _ in sorted(c.items(), key=lambda x: (-x[1], np.uint64(x[0]).view(np.int64)))[: language_id.GRAMS]} for lang, c in often.items()}
    for r in rows:
        grams = [int(x) for _, h in language_id.gram_hashes(language_id.letters(r.text or "")) for x in h]
        if not grams:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        places = list(zip(*(p.tolist() for p in filters._places(np.array(grams, np.uint64))), strict=True))
        shares = []
        for i, lang in enumerate(filters.languages):
            hits = sum(all(filters.table[i // 8, p] >> i % 8 & 1 for p in three) for three in places)
            shares.append((max(0.0, (hits - len(grams) * filters.false[i]) / (1 - filters.false[i])) / len(grams), -i, lang))
        share, _, lang = max(shares)
        assert got[r.doc_id][0] == (lang if share else filters.default) and got[r.doc_id][1] == pytest.approx(min(1.0, share))
        n_sets += max(filters.languages, key=lambda x: sum(g in exact[x] for g in grams)) == got[r.doc_id][0]
    assert n_sets >= 0.99 * sum(any(language_id.letters(r.text or "")) for r in rows)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(1500)]
    same = [1.0] * 16
    rows += [(2000 + i, same) for i in range(60)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3020, [float("inf")] + [1.0] * 15), (None, same), (2000, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string").repartition(7)
    query = F.col("vec_id") % 20 == 0
    good = {i: np.array(np.array(v, np.float32), float) for i, v in rows if i is not None and v is not None and i < 3000}
    ids = np.array(sorted(good))
    m = np.array([good[i] for i in ids])
    want = {}
    for q in ids[ids % 20 == 0]:
        s = m @ good[q]
        order = [(-s[k], ids[k]) for k in range(len(ids)) if ids[k] != q]
        want[int(q)] = sorted(order)[:20]
    exact = defaultdict(list)
    for r in graph_search.nearest(df, query, exact=True, shard_points=400).orderBy("query_id", "rank").collect():
        exact[r.query_id].append(r)
    assert set(exact) == set(want)
    for q, rows_ in exact.items():
        assert [r["rank"] for r in rows_] == list(range(1, 21))
        assert np.allclose([r.score for r in rows_], [-s for s, _ in want[q]], atol=1e-9)
    # ties of equal vectors go to the smallest ids
    assert [r.vec_id for r in exact[2000]] == [2000 + i for i in range(1, 21)]
    found = defaultdict(set)
    for r in graph_search.nearest(df, query, shard_points=400).collect():
        found[r.query_id].add(r.vec_id)
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9
    # other lengths are spaces of their own, an id with two vectors is listed once with its best score
    odd = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0, 1.0]), (22, [1.0, 1.0]), (21, [5.0, 5.0]), (40, [1.0, 2.0, 3.0]), (20, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert sorted(collected(graph_search.nearest(odd, query))) == [(20, 1, 21, 15.0), (20, 2, 22, 3.0)]
    assert graph_search.nearest(df.limit(0), query).count() == 0
    few = graph_search.nearest(df.where("vec_id < 5"), query).collect()
    assert len(few) == 4


def test_recall_of_whole_shards(spark):
    """Against brute force, in shards of thousands of points and of the usual size."""
    df = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").where("vec_id < 9000")
    query, truth = F.col("vec_id") % 60 == 0, defaultdict(set)
    for r in graph_search.nearest(df, query, exact=True).collect():
        truth[r.query_id].add(r.vec_id)
    for points in (4000, graph_search.SHARD_POINTS):
        found = graph_search.nearest(df, query, shard_points=points).collect()
        assert sum(r.vec_id in truth[r.query_id] for r in found) / sum(map(len, truth.values())) >= 0.9
