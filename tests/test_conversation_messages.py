"""Each call to a conversation's state is a message to Spark: a new key clears nothing, a known one writes only what changed."""

import json

from pyspark.sql import Row

from marlstone.streaming.conversation import _Conversation


class State:
    def __init__(self):
        self.calls, self.value, self.map, self.list = [], None, {}, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.value if self.value is not None else iter([(b,) for (b,) in self.list]) if self.list else None
            if name == "iterator":
                return iter(self.map.items())
            if name == "update":
                self.value = args[0]
            if name == "updateValue":
                self.map[args[0]] = args[1]
            if name == "put":
                self.list = args[0]
            return iter(())

        return call


class Handle(State):
    def __init__(self):
        super().__init__()
        self.states = {}

    def getValueState(self, name, _):
        return self.states.setdefault(name, State())

    getListState = getValueState

    def getMapState(self, name, *_):
        return self.states.setdefault(name, State())


def turn(n, at, **more):
    return Row(user="a", x_order=n, x_time=None, x_told=json.dumps({"at": at, "failed": False, "intent": "i", **more}))


def test_messages():
    it, handle = _Conversation("user", ["colour"], 1000), Handle()
    it.init(handle)
    first = list(it.handleInputRows(("a",), iter([turn(2, 20, slots=["red"], budget=2.0), turn(1, 10, slots=["blue"]), turn(3, 30, slots=[None])]), None))
    assert [tuple(r) for r in first] == [("a", 3, 0, "i", "colour:blue=1;colour:red=1", "2.00")]
    assert sum(len(s.calls) for s in (handle, *handle.states.values())) == 6  # one read, a summary, two wishes, the budgets, a timer
    for s in (handle, *handle.states.values()):
        s.calls.clear()
    again = list(it.handleInputRows(("a",), iter([turn(4, 40, slots=["red"])]), None))
    assert [tuple(r) for r in again] == [("a", 4, 0, "i", "colour:blue=1;colour:red=2", "2.00")]
    assert handle.states["wishes"].calls == ["iterator", "updateValue"] and handle.states["budgets"].calls == ["get"] and handle.calls == ["deleteTimer", "registerTimer"]
