"""op3 and op4 against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import near_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


# --- near duplicates


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))])
        matched = longest_common(a.tolist(), b.tolist())
        assert near_dedup.banded_matches(a, b, 40) == matched
        for similarity in (0.3, 0.5, 0.8, 1.0):
            want = matched >= similarity * (len(a) + len(b) - matched) - 1e-9
            assert near_dedup.similar(a, b, similarity) == want


def test_sketches_keep_text_order():
    words = near_dedup.word_hashes(" ".join(f"w{i}" for i in range(200)))
    turned = np.concatenate((words[100:], words[:100]))
    same = near_dedup.sketch(near_dedup.shingle_hashes(words)) == near_dedup.sketch(near_dedup.shingle_hashes(turned))
    assert same.sum() < 12  # equal shingles in another order are told apart
    assert near_dedup.occurrences(np.array([5, 3, 5, 5, 3])).tolist() == [0, 0, 1, 2, 1]


def classes(rows):
    """Smallest doc id of the class of each row, by comparing everything with everything."""
    shingles = [near_dedup.shingle_hashes(near_dedup.word_hashes(t or "")) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i]) and len(shingles[j]) and near_dedup.similar(shingles[i], shingles[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return {rows[i][0]: min(groups[root(i)]) for i in range(len(rows))}


def near_rows():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(text))
                rng.choice([lambda: text.pop(k), lambda: text.insert(k, "new"), lambda: text.__setitem__(k, rng.choice(vocabulary))])()
            rows.append((len(rows) * 3, " ".join(text)))
    rows += [(1001 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(10)]
    rows += [(2001, "one two three"), (2002, "ONE, two three!"), (2003, "one two four"), (2004, None), (2005, ""), (2006, "... !!"),
             (2007, "again " * 400), (2008, "again " * 401)]
    return rows


def test_classes_against_brute_force(spark):
    rows = near_rows()
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, text string, root string, size int")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame).collect()}
    assert got == classes(rows)


def test_families_that_share_most_of_their_text_with_a_crowd(spark):
    # shingles of a text: 85 of all, 4 of its family, 11 of its own; 89 / 111 inside a family, 85 / 115 across
    passage = [f"p{i}" for i in range(89)]
    rows = []
    for family in range(150):
        for member in range(2):
            own = [f"f{family}x{i}" for i in range(4)] + [f"o{family}x{member}x{i}" for i in range(11)]
            rows.append((2 * family + member, " ".join(passage + own)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame).collect()}
    assert got == {doc: doc - doc % 2 for doc, _ in rows}


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_rare_shingles_against_brute_force(spark, similarity):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(40) for _ in range(rng.randrange(1, 14))]) for i in range(60)]
    for i in range(60, 200):
        row = list(rng.choice(rows)[1])
        for _ in range(rng.randrange(3)):
            row[rng.randrange(len(row))] = rng.randrange(40)
        rows.append((i, row))
    packed = [(str(i).encode(), str(i).encode(), np.array(r, dtype="<u4").tobytes()) for i, r in rows]
    frame = spark.createDataFrame(packed, "vertex binary, root binary, row binary")
    rare = near_dedup._rare(frame, near_dedup._frequencies(frame.select("vertex", "row")), similarity)
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in near_dedup._sharing(rare, similarity).collect()}
    for i, a in rows:
        for j, b in rows[:i]:
            common = sum((Counter(a) & Counter(b)).values())
            if common >= similarity * (len(a) + len(b) - common) - 1e-9:
                assert frozenset((str(i).encode(), str(j).encode())) in got


def test_classes_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = near_dedup.near_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in found} == classes(rows)
    sizes = Counter(r.class_id for r in found)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)


def test_one_document_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "a"), (5, text, "a"), (3, text.upper(), "b"), (9, "something else", "c"), (None, text, "d"), (None, None, "e"), (2, None, "f")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string")
    kept = near_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.k1) for r in kept.collect() if r.doc_id is not None) == [(2, "f"), (3, "b"), (9, "c")]
    assert sorted(r.k1 for r in kept.collect() if r.doc_id is None) == ["e"]
    assert near_dedup.near_classes(frame.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("b", f"c{i}") for i in range(40)] + [("b", "c1"), ("z", "y")]
    frame = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    roots = {bytes(r.vertex).decode(): bytes(r.root).decode() for r in near_dedup.components(frame).collect()}
    assert {roots[f"a{i:03d}"] for i in range(61)} == {"a000"}
    assert {roots[f"c{i}"] for i in range(40)} == {"b"} and roots["z"] == "y"


# --- repeated byte strings


def covered(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = True
        out.append(mark)
    return out


def random_texts(rng, alphabet):
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(6)]
    texts = []
    for _ in range(15):
        text = ""
        for _ in range(rng.randrange(0, 4)):
            base = rng.choice(bases)
            at = rng.randrange(len(base))
            text += base[at:at + rng.randrange(100)] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 6)))
        texts.append(rng.choice("xy") * rng.randrange(90) if rng.random() < 0.2 else text)
    return texts


def test_merge_order_and_shared_lengths():
    rng = random.Random(4)
    for _ in range(40):
        runs, everything = [], []
        for _ in range(rng.randrange(1, 9)):
            run = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))), b"", 1, bytes(16)) for _ in range(rng.randrange(1, 20)))
            everything += [r[0] for r in run]
            runs.append(suffix_dedup.Run(suffix_dedup.encode_run(run)))
        merged = list(suffix_dedup.merge_runs(runs))
        assert [r[0] for _, r in merged] == sorted(everything)
        for (_, before), (common, record) in zip(merged, merged[1:]):
            assert common == suffix_dedup.shared(before[0], record[0])


@pytest.mark.parametrize("crowd", [10_000, 12, 2])
@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abcdefgh"), (3, "aé😀b")])
def test_spans_against_brute_force(spark, seed, alphabet, crowd):
    texts = random_texts(random.Random(seed), alphabet)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, length=24, gram=6, crowd=crowd).collect()}
    for i, mark in enumerate(covered([t.encode() for t in texts], 24)):
        data = texts[i].encode()
        assert bytes(got[i].kept) == np.frombuffer(data, np.uint8)[~mark].tobytes()
        assert got[i].n_removed == mark.sum() and got[i].n_bytes == len(data)
        assert len(got[i].removed) == (np.diff(np.concatenate(([0], mark.astype(int), [0]))) == 1).sum()


def test_lines_of_very_many_texts_are_dealt_on(spark, monkeypatch, tmp_path):
    """A line below the length in every text, one above it in some, and copies: no group holds more than the crowd allows."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line, close, over = word(300), word(392), word(430)
    texts = [word(rng.randrange(450)) + line + word(rng.randrange(450)) for _ in range(1200)]
    texts += [word(400) + close + word(400) for _ in range(300)] + [word(350) + over + word(350) for _ in range(300)]
    texts += texts[:40] + [t[100:] + word(30) for t in texts[40:80]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    log = tmp_path / "groups"
    merged = suffix_dedup._merged

    def watched(batches, length, gram):
        """Writes down the sizes of the groups before they are solved."""
        batches, runs = list(batches), {}
        for batch in batches:
            for bucket, piece in zip(batch.column("bucket").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                runs.setdefault(bucket, []).append(suffix_dedup.Run(piece))
        for found in runs.values():
            sizes = []
            for common, _ in suffix_dedup.merge_runs(found):
                if common < gram or not sizes:
                    sizes.append(0)
                sizes[-1] += 1
            with log.open("a") as out:
                out.write(f"{max(sizes)}\n")
        return merged(iter(batches), length, gram)

    monkeypatch.setattr(suffix_dedup, "_merged", watched)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, crowd=100).collect()}
    for i, mark in enumerate(covered([t.encode() for t in texts], 400)):
        assert bytes(got[i].kept) == np.frombuffer(texts[i].encode(), np.uint8)[~mark].tobytes()
    assert max(map(int, log.read_text().split())) <= 200


def test_large_groups_are_not_compared_pair_by_pair(monkeypatch):
    """A line just below the length with surroundings that match by chance: one comparison per neighbour, not per pair."""
    rng = random.Random(21)
    word = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    line = word(396)
    made = [(line[150:] + word(154), line[:150][::-1] + word(150)) for _ in range(1000)]
    made = [(right, left, 1, hashlib.blake2b(left + right, digest_size=16).digest()) for right, left in made]
    made.sort(key=lambda r: (r[0], r[1]))
    near = [0, *[suffix_dedup.shared(a[0], b[0]) for a, b in zip(made, made[1:])]]
    compared = []
    common = suffix_dedup._common
    monkeypatch.setattr(suffix_dedup, "_common", lambda a, b, limit: compared.append(len(a)) or common(a, b, limit))
    got = {key: (back, ahead) for key, back, ahead in suffix_dedup.solve_group(made, near)}
    assert sum(compared) < 2 * len(made)
    seen = Counter((o, left[:o], right[:400 - o]) for right, left, *_ in made for o in range(301))
    for right, left, _, key in made:
        shared = [o for o in range(301) if seen[o, left[:o], right[:400 - o]] > 1]
        assert got.get(key) == ((max(shared), 400 - min(shared)) if shared else None)
    assert 0 < len(got)


def test_contexts_are_folded_before_they_leave_a_task():
    data = bytes(range(97, 107)) * 5 + bytes(range(48, 58)) * 80
    batch = pa.RecordBatch.from_arrays(
        [pa.array([3, 1, 2]), pa.array([0, 0, 0]), pa.array([data] * 3, pa.binary()), pa.array([[400], [400], [400, 50]], pa.list_(pa.int32()))],
        ["k1", "k2", "data", "crowded"])
    rows = pa.Table.from_batches(suffix_dedup._contexts(iter([batch, batch]), 400, 100)).to_pylist()
    assert sorted((r["k1"], r["place"], r["back"], r["ahead"], r["n"]) for r in rows) == [(1, 400, 300, 400, 6), (2, 50, 50, 400, 2)]


def test_crowds_of_copies_go_to_one_group(spark, monkeypatch, tmp_path):
    """Places of a line above the crowd, its distinct contexts below: each context is dealt once, however long the line."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line, passage = word(520), word(610)
    texts = [word(350) + line + word(350) for _ in range(30)] * 5
    log = tmp_path / "deals"
    pieces = suffix_dedup._pieces

    def watched(batches, *rest):
        batches = list(batches)
        with log.open("a") as out:
            for batch in batches:
                for dealt in batch.column("dealt").to_pylist():
                    counts = Counter(d["place"] for d in dealt or ())
                    out.write(f"{max(counts.values(), default=0)}\n")
        return pieces(iter(batches), *rest)

    monkeypatch.setattr(suffix_dedup, "_pieces", watched)
    for crowd in (100, 20):
        mixed = texts if crowd == 100 else texts + [word(300) + passage + word(300) for _ in range(90)]
        frame = spark.createDataFrame(list(enumerate(mixed)), "doc_id bigint, text string").repartition(4)
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, crowd=crowd).collect()}
        for i, mark in enumerate(covered([t.encode() for t in mixed], 400)):
            assert bytes(got[i].kept) == np.frombuffer(mixed[i].encode(), np.uint8)[~mark].tobytes()
        if crowd == 100:
            assert max(map(int, log.read_text().split())) == 1


def test_removed_bytes_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    for (doc, data), mark in zip(rows, covered([t for _, t in rows], 400), strict=True):
        kept = np.frombuffer(data, np.uint8)[~mark].tobytes()
        assert (got[doc].n_removed, got[doc].kept_sha256) == (mark.sum(), hashlib.sha256(kept).hexdigest())


def test_suffix_edge_cases(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(450))
    rng = random.Random(9)
    rows = [(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "a" * 399, "k"), (5, "a" * 401, "k"), (None, "b" * 2000, "k"),
            (6, "".join(rng.choice("xyzw") for _ in range(5000)), "k")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, data string")
    got = sorted((r.doc_id if r.doc_id is not None else 0, r.n_bytes, r.n_removed, r.n_spans)
                 for r in suffix_dedup.digest(suffix_dedup.remove_repeats(frame)).collect())
    assert got == [(0, 2000, 2000, 1), (1, 450, 450, 1), (1, 450, 450, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 399, 0, 0), (5, 401, 401, 1), (6, 5000, 0, 0)]
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_anchors_do_not_depend_on_block_borders():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 900, dtype=np.uint8).tobytes()
    data = bytearray(rng.integers(97, 123, 2 * suffix_dedup.BLOCK + 5000, dtype=np.uint8).tobytes())
    for at in (suffix_dedup.BLOCK - 450, 2 * suffix_dedup.BLOCK - 100):
        data[at:at + 900] = passage
    places, codes = suffix_dedup.anchors(bytes(data))
    alone, alone_codes = suffix_dedup.anchors(passage)
    known = dict(zip(places.tolist(), codes.tolist(), strict=True))
    for at in (suffix_dedup.BLOCK - 450, 2 * suffix_dedup.BLOCK - 100):
        assert all(known.get(at + p) == c for p, c in zip(alone.tolist(), alone_codes.tolist(), strict=True))
