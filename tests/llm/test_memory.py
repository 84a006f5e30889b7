"""What Python workers hold and are sent: nothing of earlier operators, and each text once."""

import pyarrow as pa
import pytest

from kmerloom.llm import common, decontaminate, quality, simhash, token_orc
from kmerloom.llm.common import kept, let_go


def test_a_worker_keeps_one_thing():
    let_go()
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [kept(("a",), make(1)), kept(("a",), make(2)), kept(("b",), make(3)), kept(("a",), make(4))] == [1, 1, 3, 4]
    assert made == [1, 3, 4] and len(common._KEPT) == 1
    let_go()
    assert not common._KEPT


@pytest.mark.parametrize("task", [decontaminate._matcher([], False), simhash._fingerprints])
def test_tasks_let_go_of_tokenizers(task):
    """Workers are used again: what the tokens stage cached is not held while another operator's tasks run."""
    token_orc.coder(token_orc._file())
    assert common._KEPT
    assert list(task(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]))) == []
    assert not common._KEPT


def test_texts_are_sent_once(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    model = quality.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    for done, sent in ((quality.keep_good(docs, model, 0.0), 1), (decontaminate.decontaminate(docs, bench), 2)):
        plan = done._jdf.queryExecution().analyzed()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().head()
        fields = plan.children().head().schema().fields()
        assert len(fields) == sent
        assert sum(f.dataType().catalogString().count("string") for f in fields) == 1 and not any("binary" in f.dataType().catalogString() for f in fields)
        assert sorted(map(str, done.collect())) == sorted(map(str, docs.collect()))
