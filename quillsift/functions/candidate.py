"""Holds a candidate's code in a process of its own and answers the judge's calls.

Nothing that is written here is believed: answers are read by a loader for plain values.
"""

import json
import os
import pickle
import struct
import sys
import types

MODULE = "__candidate__"


def failed(error):
    try:
        text = repr(error)
    except BaseException:
        text = type(error).__name__
    return ["raised", [k.__name__ for k in type(error).__mro__], text]


def answer(space, kind, *rest):
    if kind == "load":
        for part in rest[0]:
            exec(compile(part, "<part>", "exec"), space)
        return ["done"]
    name = rest[0]
    if kind == "has":
        return ["known", callable(space.get(name))]
    args, named = rest[1], rest[2]
    value = space[name](*args, **named)
    for given in ([*args, *named.values()], []):
        try:
            return ["value", pickle.dumps((value, *given)).hex()]
        except BaseException:
            continue
    return ["opaque", type(value).__name__]


def main():
    source, sink = os.fdopen(os.dup(0), "rb"), os.fdopen(os.dup(1), "wb")
    silent = os.open(os.devnull, os.O_RDWR)
    for fd in (0, 1, 2):
        os.dup2(silent, fd)
    module = types.ModuleType(MODULE)
    sys.modules[MODULE] = module
    space = module.__dict__
    while len(head := source.read(8)) == 8:
        try:
            found = answer(space, *pickle.loads(source.read(struct.unpack("<Q", head)[0])))
        except BaseException as e:
            found = failed(e)
        data = json.dumps(found, ensure_ascii=True).encode()
        sink.write(struct.pack("<Q", len(data)) + data)
        sink.flush()


if __name__ == "__main__":
    main()
