import pyarrow as pa
import pytest

from siftwell.llm import common, quality, simhash, tokens

TEXTS = pa.array(["one two three four five six", None])


def similar():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1]), TEXTS], ["node", "rep", "text"])
    return list(simhash._compared(iter([batch]), 5, 0.8))


def signed():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([1, 2], pa.int32()), TEXTS], ["id", "row_key", "row_check", "text"])
    none = tokens.np.zeros(0, tokens.np.uint64), tokens.np.zeros(0, tokens.np.int64)
    return list(simhash._signatures(iter([batch]), 5, none, 0.8))


def measured():
    return quality.measures_of(TEXTS)


@pytest.mark.parametrize("work", [similar, signed, measured])
def test_a_worker_lets_go_of_the_tokenizer(tmp_path, work):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), TEXTS], ["id", "key", "text"])
    tokens._write_shard, own = lambda *args: args[3:5], tokens._write_shard
    tokens.TaskContext.get, get = staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()), tokens.TaskContext.get
    try:
        list(tokens._write_shards(iter([batch]), f"file://{tmp_path}", path, 2))
    finally:
        tokens._write_shard, tokens.TaskContext.get = own, get
    assert tokens.encoder.cache_info().currsize == 1  # for the next task of its kind
    work()
    assert tokens.encoder.cache_info().currsize == 0 and not common._kept
