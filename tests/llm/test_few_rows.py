import pyarrow as pa

from priceforge.llm import corpus, repeats


def test_slices_have_few_rows_and_their_own_lists():
    lists = [[{"lo": i, "n": i + k} for k in range(i % 4)] or None for i in range(2500)]
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(lists, kind)], names=["doc_id", "parts"])
    found = list(corpus.few_rows(iter([batch, batch.slice(0, 0), batch.slice(2000, 7)])))
    assert [b.num_rows for b in found] == [1024, 1024, 452, 7]
    for own in found:
        counts, (low, n) = repeats.listed(own.column(1), ("lo", "n"))
        want = [own for i in own.column(0).to_pylist() for own in lists[i] or []]
        assert counts.sum() == len(want)
        assert low.tolist() == [w["lo"] for w in want] and n.tolist() == [w["n"] for w in want]
