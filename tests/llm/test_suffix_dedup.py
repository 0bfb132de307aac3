from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import odd
import pytest
from brute import passages, without
from compare import rows_of

from emberline.llm import induced
from emberline.llm import suffix_dedup as S


def naive(text: list[int]) -> tuple[list[int], list[int]]:
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for p, q in zip(sa, sa[1:]):
        n = 0
        while max(p, q) + n < len(text) and text[p + n] == text[q + n]:
            n += 1
        lcp.append(n)
    return sa, lcp


def cases():
    r = random.Random(3)
    yield [0]
    yield [1, 0]
    yield [*([1] * 50), 0]
    yield [*([1, 2] * 40), 0]
    yield [*([3, 1, 2] * 30), *([3, 1] * 5), 0]
    for symbols in (2, 3, 10, 1000):
        for n in (5, 60, 300):
            yield [*(r.randrange(1, symbols + 1) for _ in range(n)), 0]


@pytest.mark.parametrize("memory", [1 << 20, 8])
def test_suffix_array_and_common_prefixes(memory, tmp_path, monkeypatch):
    """With ``memory`` of 8 the queues are files; without the short cut all levels are induced."""
    monkeypatch.setattr(induced, "SHORT", 0)
    monkeypatch.setattr(induced, "BLOCK", 7)
    monkeypatch.setattr(induced, "ALPHABET", 20)
    for text in cases():
        store = induced.Store(str(tmp_path), memory)
        sa, lcp = induced.suffix_array(np.array(text, np.int64), store)
        assert memory > 8 or store.files or len(text) < 9
        assert (list(sa), list(lcp)) == naive(text)
        store.close()


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    r = random.Random(seed)
    shared = [odd.prose(seed * 100 + i, r.randrange(40, 130), 90) for i in range(6)]
    out = []
    for i in range(n):
        parts = [odd.prose(seed * 1000 + i, r.randrange(0, 90), 90)]
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            x = r.choice(shared).split()
            a = r.randrange(0, 12)
            parts += [" ".join(x[a : len(x) - r.randrange(0, 9)]), odd.prose(r.random(), r.randrange(0, 5), 90)]
        out.append((i * 2 + 1, " ".join(parts)))
    return out


def as_rows(df):
    return sorted((r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"], r["first_word"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "memory"), [(1, 1 << 20), (2, 64), (3, 1 << 20)])
def test_passages_are_those_of_brute_force(spark, seed, memory):
    docs = corpus(seed)
    want = passages(docs)
    assert len(want) > 30
    assert as_rows(S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), memory=memory)) == want


def test_repeats_inside_a_document(spark):
    docs = [(1, "la " * 400), (2, "la " * 30 + odd.prose(5, 60) + " and " + odd.prose(5, 60)), (3, "do re mi " * 100)]
    assert as_rows(S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))) == passages(docs)


def test_a_text_cut_out_leaves_the_rest(spark):
    docs = corpus(4)
    spans = {}
    for d, a, n, _, _ in passages(docs):
        spans.setdefault(d, []).append((a, a + n))
    got = S.remove_passages(spark.createDataFrame([(d, t, len(t)) for d, t in docs], "doc_id long, text string, n_chars int"))
    want = {d: without(t, spans.get(d, [])) for d, t in docs}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    # nothing repeats any more, but for passages that the cuts bring together
    left = passages(sorted(want.items()))
    assert sum(n for _, _, n, _, _ in left) < 0.02 * sum(n for _, _, n, _, _ in passages(docs))


def test_odd_documents(spark):
    """Rows that repeat id and text are one; here that is so for document 2."""
    unique = list({(r[0], r[1]) for r in odd.rows()})
    want = passages(unique)
    assert as_rows(S.repeated_passages(odd.documents(spark))) == want
    docs = odd.documents(spark)
    got = S.remove_passages(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert got.count() == docs.count()
    untouched = "doc_id is null or doc_id not in (%s)" % ",".join(str(x[0]) for x in want)
    assert rows_of(got.where(untouched)) == rows_of(docs.where(untouched))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[2] == "." * (odd.rows()[1][1][-1] == ".") and texts[5] is None and texts[6] == ""


def test_a_passage_of_most_documents(spark):
    """Anchors and chunks that repeat within a flush and across tasks; some documents hold the passage cut short."""
    passage = odd.prose(1, 75).split()
    docs = [(i, " ".join([odd.prose(100 + i, i % 5, 10**6), *passage[: 75 - i % 3], odd.prose(9000 + i, i % 4, 10**6)])) for i in range(300)] + [(400 + i, odd.prose(500 + i, 60, 10**6)) for i in range(30)]
    assert as_rows(S.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == passages(docs)


def test_chunk_hashes_tell_kinds_apart():
    r = np.random.default_rng(1)
    size = r.integers(1, 9, 4000)
    words = r.integers(0, 3, int(size.sum())).astype(np.uint32)
    parts = [tuple(x) for x in np.split(words, np.cumsum(size)[:-1])]
    kinds = [tuple(x) for x in S.chunk_hashes(words, size).tolist()]
    assert len(set(zip(parts, kinds))) == len(set(parts)) == len(set(kinds))


def test_empty_table(spark):
    assert S.repeated_passages(odd.empty(spark)).count() == 0
    got = S.remove_passages(odd.empty(spark))
    assert got.count() == 0 and got.columns == odd.empty(spark).columns


SHARD = """
import resource, sys
import numpy as np
import pyarrow as pa
from emberline.llm import suffix_dedup as S

K, SIZE, COPIES = 50, 66, 4
memory, chunks, room = (int(x) for x in sys.argv[1:])


def batches():
    r = np.random.default_rng(5)
    for first in range(0, chunks, 2000):
        # two kinds of chunk for each anchor: the second begins with another word; each comes COPIES times
        n = 2000 // (2 * COPIES)
        words = np.repeat(r.integers(1, 1 << 31, (n, SIZE)).astype(np.uint32), 2 * COPIES, axis=0)
        words[1::2, 0] += 1
        ids = first + np.arange(len(words))
        anchor = np.repeat(first // (2 * COPIES) + np.arange(n), 2 * COPIES)
        kind = anchor * 2 + ids % 2
        meta = np.column_stack([anchor, kind, kind, ids, ids, np.zeros(len(ids)), np.full(len(ids), SIZE), np.ones(len(ids))]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((0, b"", words.tobytes(), meta.tobytes(), b""), (pa.int32(), *[pa.binary()] * 4))], names=list("bacde"))


list(S._windows(K, 1 << 12)(x for _, x in zip(range(1), batches())))  # what the libraries take
if room:
    data = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmData:")) << 10
    resource.setrlimit(resource.RLIMIT_DATA, (data + (room << 20),) * 2)
rows = 0
for out in S._windows(K, memory)(batches()):
    kind, lo, fk = (out.column(i).to_numpy() for i in (0, 2, 4))
    group = kind // 2 * (2 * COPIES)
    # windows from the second word on are those of the anchor's first chunk; a second kind's own first word stays once
    assert ((fk == group) | (fk == group + 1) & (kind % 2 == 1) & (lo == 0)).all()
    rows += len(kind)
print(rows)
"""


def test_a_shard_far_above_memory_keeps_to_a_memory_limit(tmp_path):
    """2 million words of chunks, 30 times ``memory``, in 48 MB."""
    env = {**os.environ, "SPARK_LOCAL_DIRS": str(tmp_path), "OPENBLAS_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", SHARD, str(1 << 16), "30000", "48"], cwd=os.path.dirname(S.__file__) + "/../..", env=env, capture_output=True, text=True, timeout=300)
    # for each anchor: a run of the first kind, and two of the second
    assert (done.stdout.strip(), done.stderr) == (str(3750 * 3), "")


SORT = """
import resource, sys
import numpy as np
from emberline.llm import induced

memory, n, room = (int(x) for x in sys.argv[1:])
r = np.random.default_rng(1)


def text(n):
    x = np.lib.format.open_memmap(sys.stdin.readline().strip(), "w+", np.int64, (n + 1,))
    for a in range(0, n, 100_000):
        x[a : min(n, a + 100_000)] = r.integers(1, 200, min(100_000, n - a))
    half = n // 3
    x[half : 2 * half] = x[:half]  # a long repeat
    x[n] = 0
    return x


def sort(x):
    store = induced.Store(None, memory)
    sa, lcp = induced.suffix_array(x, store)
    files = store.files
    store.close()
    return sa, lcp, files


sort(text(3000))  # what the libraries take
x = text(n)
data = next(int(v.split()[1]) for v in open("/proc/self/status") if v.startswith("VmData:")) << 10
resource.setrlimit(resource.RLIMIT_DATA, (data + (room << 20),) * 2)
sa, lcp, files = sort(x)
p, q, m = sa[0:n:997], sa[1 : n + 1 : 997], lcp[1 : n + 1 : 997]
for a, b, c in zip(p.tolist(), q.tolist(), m.tolist()):
    k = min(c, 500)
    assert (x[a : a + k] == x[b : b + k]).all() and x[a + c] < x[b + c]
print(files, int(np.max(lcp)))
"""


def test_sorting_far_above_memory_keeps_to_a_memory_limit(tmp_path):
    """A text of 1.5 million symbols, 90 times ``memory``, is sorted in 64 MB; its arrays would take several times as much."""
    n = 1_500_000
    env = {**os.environ, "TMPDIR": str(tmp_path), "OPENBLAS_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", SORT, str(1 << 14), str(n), "64"], input=f"{tmp_path}/a.npy\n{tmp_path}/b.npy\n", cwd=os.path.dirname(S.__file__) + "/../..", env=env, capture_output=True, text=True, timeout=300)
    assert done.stderr == ""
    files, longest = map(int, done.stdout.split())
    assert files > 10 and longest >= n // 3 - 1
