"""Operator 1 passes each hash on once a text, and by slices of text."""

import pyarrow as pa

from tidemark.llm import substrings
from tidemark.llm.words import SLICE_BYTES


def texts_of(rows, words):
    return [" ".join(f"w{i}x{j}" for j in range(words)) for i in range(rows)]


def test_a_window_that_a_text_repeats_is_one_row():
    line = " ".join(f"a{i}" for i in range(13))
    batch = pa.RecordBatch.from_pydict({"text": [" ".join([line] * 50), line], "key": [1, 2]})
    rows = [
        (h, k)
        for found in substrings._first_level(7, 13)(iter([batch]))
        for h, k in zip(found.column("hash").to_pylist(), found.column("key").to_pylist(), strict=True)
    ]
    assert len(rows) == len(set(rows)) and {k for _, k in rows} == {1, 2}
    assert {h for h, k in rows if k == 2} <= {h for h, k in rows if k == 1}


def test_full_windows_are_passed_on_by_slices():
    texts = texts_of(500, 400)
    first = pa.RecordBatch.from_pydict({"text": texts, "key": list(range(500))})
    marks = [[] for _ in texts]
    for found in substrings._first_level(7, 13)(iter([first])):
        for h, k in zip(found.column("hash").to_pylist(), found.column("key").to_pylist(), strict=True):
            marks[k].append(h)
    columns = {"text": texts, "doc": list(range(500)), "first": list(range(500))}
    columns["marks"] = pa.array(marks, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict(columns)
    parts = list(substrings._next_level(7, 13)(iter([batch])))
    assert batch.column("text").nbytes > 2 * SLICE_BYTES and len(parts) > 2
    assert sum(part.num_rows for part in parts) == 500 * (400 - 13 + 1)


def test_copies_carry_no_hashes_to_python(spark, monkeypatch):
    seen = substrings._rebuilt

    def spied(window, with_text):
        run = seen(window, with_text)

        def checked(batches):
            for batch in batches:
                for doc, first, repeats in zip(*[batch.column(c).to_pylist() for c in ("doc", "first", "repeats")], strict=True):
                    assert doc == first or not repeats
                yield from run(iter([batch]))

        return checked

    monkeypatch.setattr(substrings, "_rebuilt", spied)
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, f"{shared} one"), *[(i, f"{shared} two") for i in range(2, 40)], (None, f"{shared} two")]
    found = substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.row.doc_id: r.n_removed for r in found}
    assert got == {1: 0, 2: 20, None: 0} | {i: 21 for i in range(3, 40)}
