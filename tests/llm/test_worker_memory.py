"""Memory that Python holds between the tasks of a worker."""

import pyarrow as pa

from spanloom.llm import tables


def test_each_batch_gives_back_what_arrow_freed(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(tables.pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    assert [b.to_pydict() for b in tables.giving_back(lambda rows: (b for b in rows))(iter(batches))] == [{"a": [i]} for i in range(3)]
    assert pool.released == 3
    assert list(tables.giving_back(iter)(iter([]))) == []
