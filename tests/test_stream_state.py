"""What a streamed operation reads and writes of its state."""

from __future__ import annotations

from pyspark.sql import Row

from fleetlens.streaming import workload

KEY = ("app", "run", "n1", "call")


class State:
    def __init__(self, calls):
        self.kept, self.calls = {}, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("update", "updateValue"):
                self.kept[args[0] if len(args) > 1 else None] = args[-1]
            return {
                "get": lambda: self.kept.get(None),
                "getValue": lambda k: self.kept[k],
                "containsKey": lambda k: k in self.kept,
                "iterator": lambda: iter(list(self.kept.items())),
                "clear": self.kept.clear,
            }.get(name, lambda *a: None)(*args)

        return call


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_args):  # noqa: N802
        return State(self.calls)

    getMapState = getValueState


def pieces(n, opened):
    shape = Row(*workload._names(workload._PIECE))
    near = (None, None, None)
    return [
        shape(*KEY, p, opened, "q", 2, 10 * p + 1, f"b{p}", f"b{p}", False, *(("p", "read", "5") if p else near), 10 * p + 2, "q", "read", "5")
        for p in range(n)
    ]


def test_state_is_touched_once_for_each_query_and_piece():
    handle = Handle()
    operation = workload.Operations(3)
    operation.init(handle)
    assert list(operation.handleInputRows(KEY, iter(pieces(50, 1)), None)) == []
    handle.calls.clear()
    assert list(operation.handleInputRows(KEY, iter(pieces(49, -1)), None)) == []
    assert handle.calls.count("getValue") <= 1 and handle.calls.count("updateValue") == 1 + 49
    handle.calls.clear()
    later = pieces(50, -1)[49:]
    assert list(operation.handleInputRows(KEY, iter(later), None)) == []
    assert "updateValue" not in handle.calls and handle.calls.count("clear") == 3
