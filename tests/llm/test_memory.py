"""What a worker holds beside its data: peaks as a multiple of what it is given."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from loamlog.llm import common, language_id, suffix_dedup


def peak(run):
    """Bytes at most that ``run`` holds at a time, and what it returns."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_an_automaton_is_finished_in_place():
    text = np.append(np.random.default_rng(2).integers(1, 30, 20_000, dtype=np.uint8), np.uint8(0))
    most, table = peak(lambda: language_id.suffix_automaton(text))
    states = len(table) // language_id.ALPHABET - 2
    assert table.dtype == np.int32 and len(text) < states <= 2 * len(text)
    # 2 * len(text) states of ALPHABET 4-byte cells, and lists of links and lengths
    assert most < 1.5 * 2 * len(text) * language_id.ALPHABET * 4
    for word in (text[500:600], text[:70]):  # substrings are accepted whole, from the first state on
        at = 0
        for c in word.tolist():
            at = int(table[at + c])
            assert at >= 0


def test_a_group_of_thousands_of_extents_is_hashed_in_parts():
    window, rng = 256, np.random.default_rng(1)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    line = letters(window)
    grams = suffix_dedup.gram_hashes(common.prefix_sums(common.BYTE_VALUE[np.frombuffer(line, np.uint8)]))
    place = 120 + int(grams.argmin())
    rows = [letters(120) + line + letters(120) for _ in range(3000)]
    data = [x[max(0, place + 32 - window) : place + window] for x in rows]
    counts = np.array([len(x) - window + 1 for x in data])
    anchor = np.full(len(data), grams.min(), np.uint64).view(np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(x) for x in data])
    base = np.cumsum(sizes) - sizes
    common.release()
    most, places = peak(lambda: suffix_dedup.places_of(raw, base, sizes, counts, anchor))
    assert most < 25 * len(raw)
    assert places.tolist() == [x.index(line[place - 120 : place - 88]) for x in data]
    common.release()
    most, found = peak(lambda: suffix_dedup.repeated_starts(data, counts, anchor, np.ones(len(data), np.int64), window=window))
    assert most < 50 * len(raw)
    at = 120 - max(0, place + 32 - window)  # all extents share the line and nothing else
    assert all(at in f.tolist() for f in found)


def test_texts_reach_a_worker_in_small_batches(spark):
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(300))  # 19,200 bytes
    common.small_batches(spark)

    def sizes(batches):
        for batch in batches:
            most = max((part.num_rows for part in common.slices(batch, 0)), default=0)
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([most])], names=["rows", "most"])

    rows = spark.range(0, 400, 1, 1).selectExpr(f"concat('{text}', id) AS text").mapInArrow(sizes, "rows long, most long").collect()
    assert sum(r["rows"] for r in rows) == 400
    assert max(r["rows"] for r in rows) * len(text) < 1_500_000
    assert max(r["most"] for r in rows) * len(text) < 500_000
