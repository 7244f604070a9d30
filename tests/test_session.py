from types import SimpleNamespace

from plainlake import session


def test_ease_collects_once_the_heap_has_grown():
    heap, calls = SimpleNamespace(now=0, after=0), []
    runtime = SimpleNamespace(totalMemory=lambda: heap.now, maxMemory=lambda: 1000)

    def collect():
        calls.append(heap.now)
        heap.now = heap.after

    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))
    jvm = SimpleNamespace(java=SimpleNamespace(lang=lang), System=SimpleNamespace(gc=collect))
    spark = SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm))
    for heap.now, heap.after in ((500, 0), (700, 600), (600, 0), (601, 300), (400, 0), (501, 300)):
        session.ease(spark)
    assert calls == [700, 601, 501]


def test_save_eases_the_driver(spark, monkeypatch):
    eased = []
    monkeypatch.setattr(session, "ease", eased.append)
    ws = session.Workspace(spark, "test-ease")
    assert ws.save(spark.range(5), "x").count() == 5
    assert eased == [spark]
    ws.drop()
