"""Problems 1, 2, 4 and 9: rules and lexers on single texts, operators on small tables."""

import random

import re

import pytest
from pyspark.sql import functions as F

from quillsift.llm import cutoff, pairs, residue, syntax
from quillsift.llm.grammar import C, Java, JavaScript, SyntaxProblem
from quillsift.llm.values import is_empty, language_name, words

JS, JAVA, CLANG = JavaScript(), Java(), C()

GOOD = [
    (JS, "'use strict';\nvar a = 1\nvar b = 2\nif (a) b()\nelse c()"), (JS, "class A { #x = 1; static y\n m() { return this.#x } get z() { return 1 } }"), (JS, "let {a, b: [c]} = f(), d = async (x, ...y) => { await g(x) }"),
    (JS, "for (const x of y) { if (x) continue; else break }"), (JS, "do x++; while (x < 3)"), (JS, "a = b ? c : d ? e : f; g = `x${ {a:1}.a }y${`n${1}`}`"), (JS, "switch (a) { case 1: b(); break; default: { c } }"), (JS, "x = /a[/]b/.test(y) / 2"),
    (JS, "try { a() } finally { b() }"), (JS, "var f = function* () { yield 1; yield* g() }"), (JS, "x = { async *m() {}, get a() { return 1 }, [k]: 1, ...r, 'q': 2 }"), (JS, "// only a comment"), (JS, ""), (JS, "({a, b} = c)"),
    (JAVA, "package a.b; import static x.Y.*; public final class A<T extends B & C> extends D<T> { private int x = 3, y[] = {1,2}; <U> List<Map<String, ? extends U>> f(int... a) throws X { for (String s : l) x(); return a -> b.c((x, y) -> { return 1; }); } }"),
    (JAVA, "class A { void f() { int x = (int) y; int k = switch (x) { case 1 -> 2; default -> { yield 3; } }; try (var r = open()) { } catch (A | B e) { } if (o instanceof String s && s.length() > 2) return; } }"),
    (JAVA, "enum A { X(1) { void f() {} }, Y; int z; A() {} } record R(int a, @N String b) { }"), (JAVA, "class A { void f() { f(a < b, c > d); String s = \"\"\"\n hi \"x\" \"\"\"; } }"),
    (CLANG, "typedef struct foo { int a:3; char *b[4]; } foo_t; static const foo_t x = { .a = 1, .b = { [0] = \"x\" } }; int (*fp)(int, char *);"), (CLANG, "int f(void) { char *p = (char *) malloc(sizeof(int) * 3); switch (a) { case 1: break; default: ; } goto e; e: return (x ? y : z); }"),
    (CLANG, "#define A(x) \\\n  do { x } while (0)\n#ifdef B\nint y;\n#endif\nint z;"), (CLANG, "// only a comment\n"),
]
BAD = [
    (JS, "return 1", "statement"), (JS, "const a", "statement"), (JS, "import a from 'b'", "statement"), (JS, "a b", "statement"), (JS, "f() = 1", "statement"), (JS, "else {}", "statement"), (JS, "x = 'abc", "literal"), (JS, "x = `abc", "literal"), (JS, "f(", "end"), (JS, "f(]", "delimiter"), (JS, "}", "delimiter"),
    (JAVA, "class A { void f() { x + 1; } }", "statement"), (JAVA, "class A { void f() { int x = 1 } }", "statement"), (JAVA, "class A { int f() { return 1; } ", "end"), (JAVA, "class A { char c = 'ab'; }", "literal"), (JAVA, "class A { /* x }", "literal"), (JAVA, "import a.b", "statement"),
    (CLANG, "int f() { int x = 1 return x; }", "statement"), (CLANG, "int f() { return 0; ", "end"), (CLANG, "#!/bin/sh\nset -eu\n", "statement"), (CLANG, "I must decline. \n", "statement"), (CLANG, "#if A\nint x;", "end"), (CLANG, 'char *s = "abc;', "literal"), (CLANG, "# a comment\nint x;", "statement"),
]


@pytest.mark.parametrize("language,text", GOOD)
def test_valid_files(language, text):
    language.check(text)


@pytest.mark.parametrize("language,text,kind", BAD)
def test_invalid_files(language, text, kind):
    with pytest.raises(SyntaxProblem) as e:
        language.check(text)
    assert e.value.kind == kind


def test_markers_and_python():
    merge = "x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n"
    assert [syntax.problem_kind(merge, g) for g in ("python", "javascript", "java", "c")] == ["marker"] * 4
    assert syntax.problem_kind("# ======= x =======\ny = f'{a['b']}'", "python") is None
    assert [syntax.problem_kind(t, "python") for t in ("x = 'a", "x = (1", "x = 1)", "a b", None, " ", "null", "REJECT")] == ["literal", "end", "delimiter", "statement", None, None, None, None]
    assert syntax.problem_kind("x = " + "(" * 5000, "python") is not None and syntax.problem_kind("anything", "cobol") is None


def test_long_texts_are_judged_whole():
    body = "x = [1, 2, 3]\n" * 40_000
    assert syntax.problem_kind(body, "python") is None and syntax.problem_kind(body + "y = (", "python") == "end"
    js = "var x = {a: [1, 2]};\n" * 20_000
    assert syntax.problem_kind(js, "javascript") is None and syntax.problem_kind(js + "f(", "javascript") == "end"


def test_empty_values():
    assert all(map(is_empty, [None, "", " ", "​\xa0", "```python\n```", "```\n\n```", "N/A", "None", " null ", "~~~\n~~~", " \n  "]))
    assert is_empty("```python\n" * 400 + "```\n") and is_empty("\n".join("~~~ tag-one" for _ in range(30))) and is_empty(" " * 300 + "null" + "\n" * 300)
    assert not any(map(is_empty, ["a\n" * 300, "null " * 100, "```\n" * 300 + "x", "x", "REJECT", "pass", "0", "not a", "a " * 200, "```\nx\n```"]))


def test_language_and_words():
    assert [language_name(a, b) for a, b in ((" Python\xa0", "x.c"), (None, "a/b.JS"), ("", "x.java"), (None, None))] == ["python", "javascript", "java", ""]
    assert words("It's a_b, Ünï 12.5!") == ["it", "s", "a_b", "ünï", "12", "5"] and words(None) == []


ASK = "Write a Python routine `sort_rows` that can sort every row kept in the store. Totals above 3 must raise an error."
CODE = "import os\n\n\ndef sort_rows(rows):\n    # Sorry, I cannot help it\n    assert rows, 'Sorry, I cannot sort this'\n    return sorted(rows)\n"


@pytest.mark.parametrize(
    "answer,language,want",
    [
        (None, "python", ["empty"]), ("```\n```", "java", ["empty"]), (CODE, "python", []), (ASK, "python", ["copies_question"]), ("# " + ASK.upper(), "python", ["copies_question"]), ("Task:\n" + ASK.replace(" ", "  "), "c", ["copies_question"]),
        (f'"""{ASK}"""\n' + CODE, "python", []), ("I'm sorry, but I can't help with that.", "python", ["refusal"]), ("// I must decline to write this.\n", "javascript", ["refusal"]), ("# As an assistant I am unable to share that.\npass", "python", ["refusal"]),
        ("Leider kann ich dabei nicht helfen.", "python", ["refusal"]), ("Lo siento, no puedo ayudar con eso.", "c", ["refusal", "other_language"]), ("申し訳ありませんが、お手伝いできません。", "java", ["refusal", "other_language"]), ("Das kann ich nicht schreiben, denn es ist nicht sicher und die Regeln sind streng.", "python", ["refusal", "other_language"]), (CODE[:-5], "python", ["truncated"]), (CODE[: CODE.index("'Sorry") + 9], "python", ["truncated"]),
        ("int f(void)\n{\n    return (", "c", ["truncated"]), ("function f(a) {\n  const b = `x${a", "javascript", ["truncated"]), (CODE, "java", ["other_language"]), ("function f(a) {\n  return a;\n}\n", "python", ["other_language"]), ("SELECT a FROM b\nWHERE c > 1;\n", "javascript", ["other_language"]),
        ("#!/bin/sh\nset -eu\ncp \"$1\" /srv\n", "python", ["other_language"]), ("<!DOCTYPE html>\n<html>\n<body></body>\n</html>\n", "c", ["other_language"]), ('{"a": 1,\n "b": [2]}', "python", ["other_language"]), ("Zuerst liest man die Datei ein und prüft jeden Wert von rows.", "python", ["other_language"]),
        ("まず rows を読み込み、値を確認します。", "c", ["other_language"]), ("import os\n<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\ny = 3\n", "python", []), ("# prüft den Wert\n" + CODE, "python", []),
    ],
)
def test_pair_defects(answer, language, want):
    assert pairs.pair_defects(ASK, answer, language) == want


def test_two_types_at_once():
    java = "import java.util.List;\n\npublic class Rows {\n    private final List<String> rows = new ArrayList<>();\n    public void add(String row) {\n        rows.add("
    assert pairs.pair_defects(ASK, java, "python") == ["other_language", "truncated"]
    assert pairs.pair_defects("Schreibe eine Funktion, die alles sortiert und nicht doppelt ist.", "Das kann ich leider nicht schreiben, das ist gegen die Regeln.", "python") == ["refusal"]


def test_labels_and_questions_of_any_length():
    label = "Here is once more the whole question that somebody asked me to answer today:\n"
    assert pairs.copies_question(ASK, label + ASK) and pairs.copies_question(ASK, "# " + label + "# " + ASK.upper())
    assert pairs.copies_question("Sort rows", "sort ROWS.") and pairs.copies_question("Sort rows", "Question: sort rows") and not pairs.copies_question("Sort rows", "sort(rows)\nprint(1)")
    assert not pairs.copies_question(ASK, "x = 1;\n" * 5 + '"""' + ASK) and not pairs.copies_question("", "") and not pairs.copies_question(None, "x")


SOURCE = "row_id bigint, lang string, file_path string, original_instruction string, original_code string, fixed_code string, repo string, defect string, problem string"


def test_operators_on_tables(spark):
    rows = [(1, "python", "a.py", ASK, CODE, "", "r", "x", "x"), (1, "python", "a.py", ASK, CODE, "", "r", "x", "x"), (2, None, "b.c", None, None, "int x;", None, None, None), (3, None, None, None, "x", "y", None, None, None)]
    table = spark.createDataFrame(rows, SOURCE)
    got = sorted(tuple(r) for r in pairs.defective_pairs(table).collect())
    assert got == [(1, "fixed_code", "empty"), (1, "fixed_code", "empty"), (2, "original_code", "empty")]
    assert pairs.defective_pairs(table.limit(0)).count() == 0
    assert syntax.unparsable_files(table, "row_id", ["fixed_code", "original_code"], "lang", "file_path").count() == 0
    rates = syntax.parse_rates(syntax.unparsable_files(table, "row_id", ["fixed_code", "original_code"], "lang", "file_path", rates=["repo"]), ["repo", "language"]).collect()
    assert {(r.repo, r.language): (r.files, r.unparsable) for r in rates} == {("r", "python"): (2, 0), (None, "c"): (1, 0), (None, ""): (2, 0)}
    assert syntax.parse_rates(syntax.unparsable_files(table.limit(0), "row_id", ["fixed_code"], "lang", "file_path", rates=["repo"]), ["repo"]).count() == 0


def answers(n, seed=1):
    draw = random.Random(seed)
    names = ["alpha", "bravo", "carol", "delta", "echo", "fox"]
    for k in range(n):
        a, b = draw.sample(names, 2)
        code = f"import os\n\n\ndef make_{a}({b}):\n    {a} = [x * {k} for x in {b} if x > 3]\n    if {a}:\n        raise ValueError('{b} is missing')\n    return {b}\n"
        style = k % 4
        if style == 0:
            yield code
        elif style == 1:
            yield f"Here is one way to do it.\n\n```python\n{code}```\n\nThe {a} is read first. You can raise {k} later."
        elif style == 2:
            yield f"```python\n{code}```\n\nWhat it covers:\n- handles {a}\n- skips {b}"
        else:
            yield f"```python\n{code}```"


def cut_table(spark):
    whole = list(answers(600))
    broken = [t[: len(t) - 12 - k % 7] for k, t in enumerate(whole) if k % 4 == 1 and not cutoff._whole(t[: len(t) - 12 - k % 7])][:60]
    rows = [("t", k, "f", "m", x) for k, x in enumerate(whole)] + [("t", 1000 + k, "f", "m", x) for k, x in enumerate(broken)]
    extra = [("t", 2000, "f", None, None), ("t", 2001, "f", None, ""), ("t", 2002, "f", "m", "REJECT"), ("t", 2003, "f", "m", whole[0]), ("t", 2003, "f", "m", whole[0]), ("t", 2004, "f", "m", "x = 1\n" * 50_000)]
    return spark.createDataFrame(rows + extra, "table_name string, row_id bigint, field_name string, source string, text string"), {1000 + k for k in range(len(broken))}


def test_truncation(spark):
    table, broken = cut_table(spark)
    scored = cutoff.truncated(table).collect()
    found = {r.row_id for r in scored if r.cut}
    assert len(broken & found) >= 0.95 * len(broken) and len(found - broken) <= 6
    assert not {2000, 2001, 2002} & {r.row_id for r in scored} and sum(r.row_id == 2003 for r in scored) == 2
    assert cutoff.truncated(table.limit(0)).count() == 0


def test_held_out_accuracy():
    """Trained on cuts of some values, tried on cuts of others."""
    draw = random.Random(3)
    made = lambda seed: [(t, 0) for t in answers(400, seed)] + [(p, 1) for t in answers(400, seed + 1) if (p := cutoff.cut(t, draw))]
    weights = cutoff.fit([(cutoff.hashed(cutoff.features(t, 0)), y) for t, y in made(10)])
    right = [(sum(weights[k] for k in cutoff.hashed(cutoff.features(t, 0))) > 0) == bool(y) for t, y in made(50)]
    assert sum(right) / len(right) > 0.97


def test_peaks(spark):
    rows = [("a", "x" * 100)] * 40 + [("a", "x" * (100 + k)) for k in range(60)] + [("b", "y" * (50 + k)) for k in range(50)] + [(None, "z")]
    got = {r._source: r.peak for r in cutoff.piled_lengths(spark.createDataFrame(rows, "source string, text string").withColumn("source", F.coalesce("source", F.lit("")))).collect()}
    assert got == {"a": 100, "b": 0}
    many = spark.createDataFrame([(k, f"s{k % 5}", "x" * 90) for k in range(500)], "row_id bigint, source string, text string")
    few = cutoff.add_peaks(many).collect()
    joined = cutoff.add_peaks(many, few=2).collect()
    assert sorted((r.row_id, r.peak) for r in few) == sorted((r.row_id, r.peak) for r in joined)


SLOTS = [
    "The best thing about {{ item.title | default }} is it.", "I bought the [product_name] last month.", "Dear ${user.name}, hello", "My <brand> arrived.", "Das %order_id% ist gut.", "Hello __product_name__!", "for {STORE_NAME}", "<%= brand %>", "@@order_id@@", "[INSERT BRAND HERE]",
    "My {{ " + "long slot name " * 8 + "}} arrived.",
]
PAGES = [
    "Lorem ipsum dolor sit amet, consectetur", "404 Not Found\nThe requested URL /x/1 was not found on this server.", "<h1>503 Service Unavailable</h1>", "502 Bad Gateway\nnginx", "You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um fortzufahren.",
    "Nice. We use cookies. Accept all to continue.", "Access denied. You don't have permission to access this.", "YOUR SESSION HAS EXPIRED. PLEASE SIGN IN AGAIN.", "Escriba aquí su opinión", "Votre avis ici", "Debe habilitar JavaScript para ver este contenido.", "Traceback (most recent call last):\n  x", "test test test",
]
REAL = [
    "The app showed error 404 twice, then it worked.", "Their web shop said 503 on launch day.", "The poster really prints lorem ipsum under the picture.", "Had to enable JavaScript in the old browser to register.", "A book on JavaScript with 49 exercises.", "My session with support expired but they called back.",
    "Cookie crumbs fall out easily, access to the tray is simple.", "The display says <MENU> and then <OK>, easy.", "I returned it [the blue one] and kept the grey one.", "The manual says {see page 3} in braces.", "<p>Really happy with it.</p>", "20% off and 30% happier, no regrets.", "<b>Great</b> <title>x", None, "", "Please try again later, said the hotline.",
]
QUOTED = [
    "My blah blah blah husband loved this blender.", "He kept saying test test test while the kids ate.", "The blender arrived with an internal server error sticker, try again.", "Traceback (most recent call last) jokes aside, great mug.", 'The shop only shows "Access denied. You don\'t have permission", so no spare parts.', "The screen displays lorem ipsum dolor sit amet until the first start.",
    "Its page says please enable JavaScript to view the comments.",
]

@pytest.mark.parametrize("text", SLOTS + PAGES)
def test_residue(text):
    assert any(f.decided for f in residue.findings(text))


@pytest.mark.parametrize("text", REAL + QUOTED)
def test_no_residue(text):
    assert not any(f.decided for f in residue.findings(text)) and (text in QUOTED or not residue.findings(text))


def test_slug_title_and_body_decide():
    """The same sentence is a page or speech, by what surrounds it."""
    page = "Access denied. You do not have permission to access the archive."
    assert any(f.decided for f in residue.findings(page, "Nice lamp", "itm-lamp"))
    assert not any(f.decided for f in residue.findings(page, "Archive access permission", "itm-lamp"))
    assert not any(f.decided for f in residue.findings(page, "Nice lamp", "permission-access-archive"))
    assert not any(f.decided for f in residue.findings(page + " A game about access to an archive that needs permission.", "Nice lamp", "itm-lamp"))


DDL = "doc_id bigint, text string, title string, item_key string"


def test_hosts_decide_on_wording_inside_sentences(spark):
    """A page that is known from several addresses is found inside a sentence; what reviewers say is not, however often."""
    page = "Database connection failed: too many clients (33359)"
    rows = [(k, page.replace("33359", str(k)), "Nice lamp", f"itm-{k}") for k in range(3)]
    rows += [(10, f"We sent it back, the {page} lid was scratched.", "Nice lamp", "itm-9"), (11, f"Our lamp app says {page} each morning.", "Nice lamp", "itm-8"), (12, "We saw that the database connection failed once.", "Nice lamp", "itm-7")]
    rows += [(100 + 10 * n + k, f"{t} Number {k}.", "Fine", f"itm-{k}") for n, t in enumerate(QUOTED + [x for x in REAL if x]) for k in range(4)]
    assert sorted(r.doc_id for r in residue.residue(spark.createDataFrame(rows, DDL)).collect()) == [0, 1, 2, 10]
    few = [r for r in rows if r[0] not in (1, 2)]
    assert not residue.residue(spark.createDataFrame(few, DDL)).where("doc_id >= 10").count()


def test_residue_operator(spark):
    ddl = "doc_id bigint, text string, title string, item_key string, reason string"
    rows = [(k, t, None, None, None) for k, t in enumerate(SLOTS[:3])] + [(50 + k, t, "t", "itm-a", "x") for k, t in enumerate(REAL)]
    rows += [(100 + k, "Oops! Not found.", "Nice lamp", f"itm-{k}", None) for k in range(3)] + [(200, "Try again later.", "Lamp", "itm-1", None), (201, "Untitled", "Untitled", "itm-9", None), (0, SLOTS[0], None, None, None), (300, "x " * 200_000, None, None, None)]
    table = spark.createDataFrame(rows, ddl)
    got = sorted(r.doc_id for r in residue.residue(table).collect())
    assert got == [0, 0, 1, 2, 100, 101, 102]
    assert residue.residue(table.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Access denied. Access denied.", "Please try again later. Please sign in again.", "Forbidden. Sign in."])
def test_doubtful_sentences_do_not_excuse_each_other(spark, text):
    ddl = "doc_id bigint, text string, title string, item_key string"
    rows = [(k, text, "Nice lamp", f"itm-{k}") for k in range(3)] + [(10 + k, text + " The sign on the door said access denied, please try again.", "Nice lamp", f"itm-{k}") for k in range(3)]
    rows = [r if r[0] < 10 else (*r[:2], "Sign in, try again: forbidden, access denied", r[3]) for r in rows]
    assert sorted(r.doc_id for r in residue.residue(spark.createDataFrame(rows, ddl)).collect()) == [0, 1, 2]


def test_notices_of_other_wording_need_several_addresses(spark):
    ddl = "doc_id bigint, text string, title string, item_key string"
    notices = ["The server encountered a temporary error and could not complete your request.", "Our systems have detected unusual traffic from your computer network."]
    said = ["My computer lost the network connection twice, fine after that.", "We use it about 12 times a month."]
    rows = [(10 * n + k, t, "Nice lamp", f"itm-{k}") for n, t in enumerate(notices + said) for k in range(3)] + [(90, notices[0].replace("request", "browser request"), "Nice lamp", "itm-1")]
    assert sorted(r.doc_id for r in residue.residue(spark.createDataFrame(rows, ddl)).collect()) == [0, 1, 2, 10, 11, 12]


@pytest.mark.parametrize("language", ["python", "javascript"])
def test_flat_yaml_of_any_length(language):
    for lines in (2, 4, 30):
        text = "\n".join(f"field{k}: demo" for k in range(lines))
        assert pairs.pair_defects("Write a function.", text, language) == ["other_language"]
    assert pairs.pair_defects("Write a function.", "total = 0\nfor k in range(3):\n    total += k\nprint(total, 'is the sum of all numbers at hand')\n", "python") == []


def _samples(tree, more):
    """Texts that take every alternative of a parsed pattern at least once; `more` repeats what may be left out."""
    parts = []
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(value)])
        elif op == "BRANCH":
            parts.append([x for branch in value[1] for x in _samples(branch, more)])
        elif op == "SUBPATTERN":
            parts.append(_samples(value[3], more))
        elif op == "MAX_REPEAT":
            inner = _samples(value[2], more)
            parts.append([x * max(value[0], more if value[1] else 0) for x in inner])
        elif op == "IN":
            kind, first = str(value[0][0]), value[0][1]
            parts.append([chr(first) if kind == "LITERAL" else chr(first[0]) if kind == "RANGE" else "0" if "DIGIT" in str(first) else " " if "SPACE" in str(first) else "a"])
        elif op == "ANY":
            parts.append([" "])
    base = [p[0] for p in parts]
    return ["".join([*base[:k], x, *base[k + 1 :]]) for k, p in enumerate(parts) for x in p] or [""]


def test_every_alternative_can_be_reached():
    for pattern in residue.CLEAR + residue.SOFT:
        made = {x for more in (0, 1) for x in _samples(re._parser.parse(pattern), more) if re.search(pattern, x, re.S)}
        assert made, pattern
        for text in made:
            assert residue.findings(text), (pattern, text)
