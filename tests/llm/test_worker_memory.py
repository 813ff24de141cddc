"""What Python workers keep and pass on is bounded by slices of text, not by whole batches."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import language, near, packing, tokens
from tidemark.llm.shared import TEXT_ROWS, text_batches
from tidemark.llm.words import SLICE_BYTES


def texts_of(rows, words):
    return [" ".join(f"w{i}x{j}" for j in range(words)) for i in range(rows)]


def test_encoder_remembers_only_pieces_met_in_an_earlier_slice():
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    often, once = "every slice has these words", [f"rare{i} " * 3 for i in range(40)]
    parts = [f"{often} {word}" for word in once]
    found = [coder.encode(pa.array([part]))[0].tolist() for part in parts]
    assert found == [coder.tokenizer.encode(p, add_special_tokens=False).ids for p in parts]
    assert {b"every", b"slice"} <= coder.known.keys()
    # A mark that two pieces share has one remembered a slice sooner, which is rare.
    assert len(coder.known) == coder.n <= 10
    assert coder.used == coder.size[: coder.n].sum()


def test_rows_are_encoded_by_small_slices():
    batch = pa.RecordBatch.from_pydict({"text": texts_of(700, 600)})
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = list(tokens.encoded_rows(batch, path, 0))
    assert batch.nbytes > 2 << 20 and len(parts) > 2
    assert sum(part.num_rows for part, _, _ in parts) == 700
    whole = tokens.Encoder(path).encode(batch.column("text"))[1] + 1
    assert np.concatenate([sizes for _, _, sizes in parts]).tolist() == whole.tolist()


def test_languages_are_passed_on_by_slices(spark, monkeypatch):
    made = []
    plain = spark.createDataFrame([(0, "a")], "id long, text string")
    monkeypatch.setattr(type(plain), "mapInArrow", lambda self, run, schema: made.append(run))
    model = language.fit([*["der hund und die katze"] * 3, *["the dog and the cat"] * 3], ["de"] * 3 + ["en"] * 3)
    language.predict(plain, model)
    texts = ["the dog and the cat " * 200] * 400 + [None, "", "12"]
    row = pa.array([{"id": i} for i in range(len(texts))])
    batch = pa.RecordBatch.from_arrays([row, pa.array(texts)], ["row", "text"])
    parts = list(made[0](iter([batch])))
    assert len(parts) > 2 and max(part.column("text").nbytes for part in parts) < 2 * SLICE_BYTES
    langs = [v for part in parts for v in part.column("lang_pred").to_pylist()]
    assert langs == ["en"] * 400 + ["und"] * 3
    assert [v["id"] for part in parts for v in part.column("row").to_pylist()] == list(range(len(texts)))


def test_ngrams_are_numbered_by_bounded_runs_of_code_points(monkeypatch):
    langs = [f"l{i}" for i in range(4)]
    model = language.fit([f"{lang} the dog and the cat {lang} " * 3 for lang in langs * 3], langs * 3)
    texts = [f"l{i % 4} dog x{i} cat " * 250 for i in range(256)] + ["", None, "a"]
    points, row = language.code_points(texts)
    model.presence(points, row, len(texts))
    tracemalloc.start()
    held = model.presence(points, row, len(texts))
    peak = tracemalloc.get_traced_memory()[1] - held.base.nbytes
    tracemalloc.stop()
    assert len(points) > 800_000 and peak < 20 << 20
    monkeypatch.setattr(language, "POINTS_AT_ONCE", len(points))
    assert (held == model.presence(points, row, len(texts))).all()
    # N-grams that lie across the runs are held too.
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language, "POINTS_AT_ONCE", size)
        few = language.code_points(texts[-5:])
        assert (model.presence(*few, 5) == held[-5:]).all()


def test_near_copies_get_texts_by_small_batches(spark, monkeypatch):
    inner = near._profiles

    def bounded(batch):
        assert batch.num_rows <= 1000
        return inner(batch)

    assert TEXT_ROWS <= 1000
    monkeypatch.setattr(near, "_profiles", bounded)
    docs = [(i, f"these are the words of text number {i // 2}") for i in range(2600)]
    docs = spark.createDataFrame(pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}))
    found = {r["doc_id"]: r["component_id"] for r in near.classes(docs.coalesce(1)).collect()}
    assert found == {i: i // 2 * 2 for i in range(2600)}


def test_the_batch_size_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        with pytest.raises(ZeroDivisionError), text_batches(spark):
            assert spark.conf.get(name) == str(TEXT_ROWS)
            1 / 0
        assert spark.conf.get(name, None) is None
        for given, within in (("7000", str(TEXT_ROWS)), ("7", "7"), ("0", str(TEXT_ROWS))):
            spark.conf.set(name, given)
            with text_batches(spark):
                assert spark.conf.get(name) == within
            assert spark.conf.get(name) == given
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def test_the_plan_of_packing_starts_no_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2, None], "text": ["a b c", None, "d " * 5000]}))
    made = []
    kind, plain = type(spark), type(spark).createDataFrame
    monkeypatch.setattr(kind, "createDataFrame", lambda self, data, *a, **k: made.append(data) or plain(self, data, *a, **k))
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path).collect()
    assert sorted(r["length"] for r in rows if r["id"] is not None)[0] == 1 and len(rows) > 3
    assert packing.pack_documents(docs.where("false"), path).collect() == []
    # Spark passes lists through workers of their own kind, with a daemon that stays.
    assert len(made) == 2 and all(isinstance(data, pa.Table) for data in made)


def test_remembered_pieces_are_no_python_objects():
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    column = pa.array([" ".join(f"{i}é{j}" for j in range(500)) for i in range(60)])
    held = [coder.encode(column)[0].tolist() for _ in range(3)]
    assert held[0] == held[1] == held[2] and coder.n >= 30_000
    state = vars(coder).values()
    assert all(len(value) < 100 for value in state if isinstance(value, (dict, list, set, bytearray)))
    assert sum(value.nbytes for value in state if isinstance(value, np.ndarray)) < 10 << 20
    whole = coder.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)
    assert held[0] == [i for e in whole for i in e.ids]


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "ranges_hash", lambda values, starts, ends, which: starts.astype(np.uint64) % 7)
    texts = [f"some words {i % 5} and {'more ' * (i % 3)}text" for i in range(40)]
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    found = [coder.encode(pa.array([text]))[0].tolist() for text in texts]
    assert found == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < coder.n == len(coder.known)


@pytest.mark.parametrize("write", ["tokens", "packing"])
def test_token_operators_get_texts_by_small_batches(spark, monkeypatch, write):
    module, inner = (tokens, tokens.encoded_rows) if write == "tokens" else (packing, packing.encoded_rows)

    def bounded(batch, path, end_id):
        assert batch.num_rows <= 1000
        return inner(batch, path, end_id)

    monkeypatch.setattr(module, "encoded_rows", bounded)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = pa.table({"doc_id": list(range(2600)), "text": [f"text number {i}" for i in range(2600)]})
    docs = spark.createDataFrame(docs).coalesce(1)
    if write == "tokens":
        uri = tokens.token_folder(spark)
        made = tokens.read_tokens(tokens.write_tokens(docs, path, uri), uri)
    else:
        made = packing.pack_documents(docs, path)
    assert made.select("id").distinct().count() == 2600
