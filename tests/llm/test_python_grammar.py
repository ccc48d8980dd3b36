"""Problem 2, Python: the grammar against the interpreter's parser, which takes no part in the operator."""

import ast
import inspect
import json
import os
import random
import warnings

import pandas as pd
import pytest

from quillsift.llm.grammar import SyntaxProblem
from quillsift.llm.python_grammar import Python
from quillsift.llm.syntax import problem_kind

PY = Python()
DATA = os.environ.get("QUILLSIFT_TESTDATA", "/root/testdata/sf0.01")

SAMPLES = """
x = lambda a, b=1, *c, d, **e: (a, b)
f = lambda: (yield)
1 + lambda: 0
a if b else c if d else lambda: e
[x for x in y if z if w for a, *b in c]
[x for x in y if z else w]
[x async for x in y]
f(x for x in y)
f(x for x in y, 1)
f(1, x for x in y)
f(a=1, *b, c=2, **d)
f(a=1, b)
f(**d, *b)
f(a.b=1)
f(a := 1)
a := 1
(a := 1)
not a == (not b)
a == not b
a not in b is not c
a is is b
del a, (b, c.d), e[0]
del f()
del (a, *b)
a, *b = c = d
*a, b += 1
(a) += 1
(a, b) += 1
f() = 1
x + 1 = 2
a.b: int = 3
(a): int
a, b: int
None = 1
for x.y in z: pass
for f() in z: pass
for x in *a, b: pass
with a as b, c as (d, e): pass
with (a as b, c): pass
with (a, b) as c: pass
with a as f(): pass
import a.b as c, d
from . import (a as b, c,)
from .a import b,
from ...x import *
import a[0]
global a, b
raise a from b
assert a, b
def f(a, /, b: int = 1, *c: *d, e=2, **g) -> h: pass
def f(a=1, b): pass
def f(*, **a): pass
def f(*): pass
def f(/, a): pass
def f[T: int, *U, **V](a): return
class A[T](B, metaclass=C): x = 1; y = 2;
type X[T] = list[T]
type = 1
match = case = 2
match(x)
print "x"
x = 012
x = 0_1 + 1_000.5e-3j
x = 1if y else 2
x = 1_
s = b"a" "b"
s = b"ä"
s = "\\x1"
s = "\\N{DIGIT ONE}"
s = "\\N{NO SUCH SIGN}"
s = f"{a!r:>{w}} {{}} {b['c']} {d=}"
s = f"{a"
s = f"{}"
s = f"{a b}"
s = rf"\\{a}" "x"
{**a, 'b': 1}
{a: b for a, b in c}
{a, *b}
{a: b, c}
x[1:2, ::3, *y]
x[]
await x
async def f(): await x; return [y async for y in z]
@a.b(c)
x = yield
return 1
x = *a,
()
x = (*a)
a.1
a..b
x ? y
x = `a`
x = $a
try: pass
try: x
if x: y
else: z
""".strip("\n").split("\n")
BLOCKS = [
    "try:\n  a\nexcept* B as c:\n  d\nelse:\n  e\nfinally:\n  f\n", "try:\n  a\nexcept B, C:\n  d\n", "try:\n  a\nexcept B:\n  d\nexcept* C:\n  e\n", "match x, y:\n  case [1, *_] | {'a': b, **c} if d:\n    pass\n  case A.B(c=1) as e: pass\n", "match x:\n  pass\n", "match x:\n  case a b: pass\n", "match -x:\n  case -1 + 2j: pass\n  case (a, b) | [c]: pass\n  case (a): pass\n  case A.b | None: pass\n",
    "if x:\npass\n", "if x:\n  a\n b\n", "if x:\n\ta\n        b\n", "  x = 1\n", "x = 1\n  y = 2\n", "def f():\n  '''a\n b'''\n\n  # c\n  return (1,\n2)\n", "class A:\n  x: int\n  def f(self): ...\n\n  @b\n  async def g(self): pass\n", "for a in b:\n  pass\nelse:\n  c\n", "while a: b\nelse: c\n", "x = 1 \\\n  + 2\n", "x = 1 \\ \n", "\\\n", "x = '''a", "x = {\n  'a': [1,\n   2],\n}\n", "f(a,\n  # c\n  b)\n", "\x0cx = 1\n",
    "if a:\n  if b:\n    c\n  elif d: e\nelse:\n  f\n", "@a\nx = 1\n", "async with a: pass\n", "async x\n", "with open(a) as f,\\\n  b: pass\n", "s = f'''{\n a\n}'''\n", "x = 'a\nb'\n", "# only a comment", "", "\n\n", "x\r\ny\r", "x = 1;\n", "; x\n", "x;; y\n",
]


def valid(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def accepted(text):
    try:
        PY.check(text)
    except SyntaxProblem:
        return False
    return True


@pytest.mark.parametrize("text", SAMPLES + BLOCKS)
def test_like_the_parser(text):
    assert accepted(text) == valid(text)


def test_library_modules_and_broken_pieces_of_them():
    draw = random.Random(3)
    for module in (json.decoder, inspect, ast, random, pd.core.frame):
        text = inspect.getsource(module)
        assert accepted(text)
        lines = text.split("\n")
        for _ in range(120):
            at = draw.randrange(len(lines))
            piece = inspect.cleandoc("\n".join(lines[at : at + draw.choice([1, 3, 8])]))
            k = draw.randrange(len(piece) + 1)
            piece = draw.choice([piece[:k], piece[:k] + piece[k + 1 :], piece[:k] + draw.choice("()[]{}:,='\"\\*. \n") + piece[k:]])
            assert accepted(piece) == valid(piece), piece


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_no_difference_on_the_tables():
    tasks, rows = pd.read_parquet(f"{DATA}/task_rows.parquet"), pd.read_parquet(f"{DATA}/source_rows.parquet")
    for texts in (tasks["generated_code"], rows["fixed_code"], rows["original_code"]):
        assert not [t for t in texts if isinstance(t, str) and accepted(t) != valid(t)]


def test_nesting_and_length():
    js = "1"
    for _ in range(400):
        js = f"`a${{{js}}}b`"
    assert problem_kind(f"x = {js}", "javascript") is None and problem_kind(f"x = {js[:-3]}", "javascript") == "literal"
    assert problem_kind("x = " + "(" * 150 + "1" + ")" * 150, "python") is None and problem_kind("x = " + "[" * 300 + "]" * 300, "python") == "delimiter"
    assert problem_kind("".join(" " * k + "if x:\n" for k in range(90)) + " " * 90 + "y\n", "python") is None
