"""Lexer and pushdown reduction for Python 3.13.

Works as the other languages of module `grammar`: one character for each token, closed
groups reduced to a character that says which roles they can play. Indented blocks are
groups like any other, opened and closed by two signs of their own.
"""

from __future__ import annotations

import re
import unicodedata

from quillsift.llm.grammar import Alphabet, Language, SyntaxProblem, bits

_ROUND, _SQUARE, _CURLY, _BLOCK = 0xE000, 0xE400, 0xE800, 0xEC00
INDENT, DEDENT = "\x01", "\x02"
#: The parser's own limits of nesting.
MOST_BRACKETS, MOST_INDENTS = 200, 100

_WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
)
_SIGNS = "ident num str bytes fstr nl lam reach value forin fors imports header subject pattern alias line ; , : := . ... -> = += -= *= /= //= %= @= &= |= ^= >>= <<= **= == != < > <= >= << >> + - * / // % @ ** & | ^ ~"


class Python(Language):
    """Python 3.13 files, as its parser sees them: names, scopes and types do not matter.

    Within a group precedence is worked off in passes. Each pass replaces what it has matched
    by one sign: operands with their calls and arithmetic (`reach` if they can be assigned
    to, else `value`), then tests and boolean terms, clauses of comprehensions, conditional
    expressions, and in blocks the simple statements of a line.
    """

    brackets = re.compile(r"[()\[\]{}\x01\x02]")
    closes = {"(": ")", "[": "]", "{": "}", INDENT: DEDENT}

    def __init__(self) -> None:
        super().__init__()
        a = self.a = Alphabet(_WORDS, _SIGNS, {
            "P": ["expr", "args", "params", "target", "single", "del", "names", "with", "pat", "cpat"],
            "R": ["index", "list", "target", "del", "tparams", "pat"],
            "B": ["expr", "pat"],
        })
        for k, role in enumerate(("block", "cases")):
            a.names[f"D:{role}"] = "[" + "".join(chr(_BLOCK + n) for n in range(4) if n >> k & 1) + "]"
        a.names["D:any"] = f"[{chr(_BLOCK)}-{chr(_BLOCK + 3)}]"
        d = a.define
        inside = lambda *names: "[" + "".join(a.names[n][1:-1] for n in names) + "]"
        a.names["ID"] = a.any_of("ident match case type")
        a.names["PLAIN"] = a.any_of("ident match case type reach")
        a.names["VALUES"] = a.any_of("value")
        a.names["X"] = inside("PLAIN", "VALUES", "P:expr", "R:list", "B:expr")
        a.names["T"] = inside("PLAIN", "P:target", "R:target")
        a.names["SINGLE"] = inside("PLAIN", "P:single")
        a.names["DONE"] = inside("PLAIN", "P:del", "R:del")
        a.names["AUG"] = a.any_of("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")
        a.names["ARITH"] = a.any_of("+ - * / // % @ ** << >> & | ^")
        # Operands and arithmetic.
        d("STRS", "(?>[str fstr]++(?!bytes)|bytes++(?![str fstr]))")
        d("ATOM", "(?>ID|num|STRS|True|False|None|'...'|P:expr|R:list|B:expr)")
        d("OPER", "(?>['+' '-' '~']*+ await? ATOM(?:'.' ID|P:args|R:index)*+)")
        self.operands = a.compile("OPER(?:ARITH OPER)*+")
        self.reaching = a.compile("(?:ID|num|STRS|True|False|None|'...'|P:expr|R:list|B:expr)(?:P:args*+(?:'.' ID|R:index))++ $")
        self.alone = re.compile(inside("ID", "P:*", "R:*", "B:*"))
        # Tests, clauses, conditional expressions.
        self.loops = a.compile("(?:async(?=for '*'?T))?for '*'?T(?:, '*'?T)*+ ,? in")
        d("COMP", "(?>X(?:(?>in|not in|is not|is|['==' '!=' '<=' '>=' '<' '>'])X)*+)")
        self.tests = a.compile("not*+ COMP(?:(?:and|or) not*+ COMP)*+")
        self.clauses = a.compile("(?:forin X(?:if X)*+)++")
        self.choices = a.compile("lam*+ X(?:if X else lam*+ X)*+")
        d("NAMED", "(?>(?:ID ':=')?X)")
        d("STARN", "(?>'*' X|NAMED)")
        d("SE", "(?>'*'?X(?:, '*'?X)*+ ,?)")
        d("VALUE", "(?>yield from X|yield(?:SE)?|SE)")
        # Groups; items are matched with a comma after each.
        comma = lambda item: f"(?:{item} ,)"
        self.p_single = a.compile("(?:NAMED(?:fors)?|yield from X|yield(?:SE)?)? $")
        self.p_tuple = a.compile(comma("STARN") + "++ $")
        positional, keyed, doubled = comma("(?>'*' X|NAMED)"), comma("(?>ID '=' X|'*' X)"), comma("(?>ID '=' X|'**' X)")
        self.args = a.compile(f"{positional}*+{keyed}*+{doubled}*+ $")
        self.generator = a.compile("NAMED fors $")
        self.params = self._parameters("ID(?:':' X)?", "ID(?:':' '*'?X)?")
        self.lambda_params = self._parameters("ID", "ID")
        self.targets = a.compile(comma("'*'?T") + "*+ $")
        self.one_target = a.compile("T $")
        self.single = a.compile("SINGLE $")
        self.deleted = a.compile(comma("DONE") + "*+ $")
        d("ALIAS", "(?>ID(?:as ID)?)")
        self.names = a.compile(comma("ALIAS") + "++ $")
        d("ITEM", "(?>X(?:as T)?)")
        self.with_items = a.compile(comma("ITEM") + "++ $")
        self.index = a.compile(comma("(?>X?':' X?(?:':' X?)?|STARN)") + "++ $")
        self.items = a.compile(comma("STARN") + "*+ $")
        self.type_params = a.compile(comma("(?>['*' '**']?ID(?:':' X)?(?:'=' '*'?X)?)") + "++ $")
        self.pairs = a.compile(comma("(?>'**' X|X ':' X)") + "*+ $")
        self.pair_generator = a.compile("X ':' X fors $")
        self.interpolated = a.compile("VALUE $")
        # Patterns of match statements, on the tokens as they are.
        d("DOTTED", "(?>ID(?:'.' ID)*+)")
        d("NUMBER", "(?>'-'?num(?:['+' '-'] num)?)")
        d("CLOSED", "(?>NUMBER|STRS|True|False|None|DOTTED P:cpat|DOTTED|P:pat|R:pat|B:pat)")
        d("ASPAT", "(?>CLOSED(?:'|' CLOSED)*+(?:as ID)?)")
        d("MAYBE", "(?>'*' ID|ASPAT)")
        self.group_pattern = a.compile("ASPAT $")
        self.patterns = a.compile(comma("MAYBE") + "*+ $")
        self.class_patterns = a.compile(comma("ASPAT") + "*+" + comma("ID '=' ASPAT") + "*+ $")
        self.map_patterns = a.compile(comma("(?>'**' ID|(?>NUMBER|STRS|True|False|None|ID(?:'.' ID)++)':' ASPAT)") + "*+ $")
        # Blocks: headers first, as their names and brackets are no calls.
        start = f"(?:(?<![^{a.code['nl']}{chr(_BLOCK)}-{chr(_BLOCK + 3)}]))"
        soft = f"(?:(?<![^{a.code['nl']}{a.code[';']}{a.code[':']}{chr(_BLOCK)}-{chr(_BLOCK + 3)}]))"
        self.match_heads = re.compile(start + a.pattern("match") + f"([^{a.code['nl']}]+)" + a.pattern("':'(?=nl D:cases)"))
        self.case_heads = re.compile(start + a.pattern("case(?>MAYBE(?:, MAYBE)++ ,?|MAYBE ,|ASPAT)(?=if|':')"))
        self.type_heads = re.compile(soft + a.pattern("type ID R:tparams?'='"))
        self.headers = a.compile("def ID R:tparams?P:params|class ID R:tparams?(?:P:args)?")
        self.imports = a.compile("import DOTTED(?:as ID)?(?:, DOTTED(?:as ID)?)*+|from(?:['.' '...']*+ DOTTED|['.' '...']++) import(?:'*'|P:names|ALIAS(?:, ALIAS)*+)")
        self.subject = a.compile("(?:STARN(?:, STARN)++ ,?|STARN ,|NAMED)$")
        d("SIMPLE", "(?>pass|break|continue|return(?:SE)?|raise(?:X(?:from X)?)?|(?:global|nonlocal) ID(?:, ID)*+|del DONE(?:, DONE)*+ ,?(?=[; nl])|assert X(?:, X)?|imports|alias X|SINGLE AUG VALUE|SINGLE ':' X(?:'=' VALUE)?(?![',' '='])|(?:(?>'*'?T(?:, '*'?T)*+ ,?)'=')*+ VALUE)")
        before = f"(?:(?<![^{a.code['nl']}{a.code[':']}{a.code['line']}{chr(_BLOCK)}-{chr(_BLOCK + 3)}]))"
        self.lines = re.compile(before + a.pattern("SIMPLE(?:; SIMPLE)*+ ;? nl"))
        d("BODY", "(?>':'(?:nl D:block|line))")
        d("ELSE", "(?>else BODY)")
        d("CATCH", "(?>(?:except(?:X(?:as ID)?)?BODY)++|(?:except '*' X(?:as ID)?BODY)++)")
        d("WITH", "(?>with(?:P:with BODY|ITEM(?:, ITEM)*+ BODY))")
        d("FOR", "(?>forin SE BODY ELSE?)")
        d("HEADED", "(?>header(?:'->' X)?BODY)")
        d("STMT", "(?>line|(?:'@' NAMED nl)*+(?:async HEADED|HEADED)|async WITH|if NAMED BODY(?:elif NAMED BODY)*+ ELSE?|while NAMED BODY ELSE?|FOR|try BODY(?:CATCH ELSE?(?:finally BODY)?|finally BODY)|WITH|subject nl D:cases)")
        self.block = a.compile("STMT++ $")
        self.file = a.compile("STMT*+ $")
        self.cases = a.compile("(?:pattern(?:if NAMED)?BODY)++ $")

    def _parameters(self, one: str, rest: str) -> re.Pattern:
        p, pd = f"(?:{one} ,)", f"(?:{one} '=' X ,)"
        front = f"(?:{p}++ '/' , {p}*+ {pd}*+|{p}*+ {pd}++ '/' , {pd}*+|{p}*+ {pd}*+)"
        star = f"(?:'*' (?:{rest}) , (?:{p}|{pd})*+|'*' , (?:{p}|{pd})++)?"
        return self.a.compile(f"{front}{star}(?:'**' {one} ,)? $")

    TOKEN = re.compile(
        r"""(?P<ws>[ \t\f]+|\\\n(?!\Z)|\#[^\n]*)|(?P<nl>\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*(?P<dent>[ \t\f]*(?:\\\n(?!\Z)[ \t\f]*)*))"""
        r"""|(?P<start>(?P<prefix>[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?P<quote>\"{3}|'{3}|"|'))|(?P<id>[^\W\d]\w*)"""
        r"""|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*(?![_\d])|[1-9](?:_?\d)*)(?=\W|\Z|(?:and|else|for|if|in|is|not|or)\b))"""
        r"""|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|:=|->|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=:;,.()\[\]{}])"""
    )
    WORDS = frozenset(_WORDS.split())
    BODIES = {
        '"': re.compile(r'(?:[^"\\\n]|\\(?s:.))*"'), "'": re.compile(r"(?:[^'\\\n]|\\(?s:.))*'"),
        '"""': re.compile(r'(?:[^"\\]|\\(?s:.)|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\(?s:.)|'(?!''))*'''"),
    }
    ESCAPE = re.compile(r"\\(?:x([\da-fA-F]{2})?|u([\da-fA-F]{4})?|U([\da-fA-F]{8})?|N(\{[^}]+\})?|(?s:.))")

    def lex(self, text: str) -> str:
        if "\0" in text:
            raise SyntaxProblem("statement", "null byte")
        if any("\ud800" <= c <= "\udfff" for c in text if c > "\ud7ff"):
            raise SyntaxProblem("statement", "surrogate")
        text = "\n" + text.replace("\r\n", "\n").replace("\r", "\n")
        if not text.endswith("\n"):
            text += "\n"
        out: list[str] = []
        pos = self._tokens(text, 0, out, False)
        if pos < len(text):
            self._stuck(text, pos)
        return "".join(out)

    def _stuck(self, text: str, pos: int) -> None:
        raise SyntaxProblem("statement", "sign " + text[pos])

    def _tokens(self, text: str, pos: int, out: list[str], hole: bool) -> int:
        """Lexes from pos to the end, or in a hole of a formatted string to the sign that ends it."""
        code, add, words, size = self.a.code, out.append, self.WORDS, len(text)
        nl, ident = code["nl"], code["ident"]
        stack: list[str] = []
        indents: list[tuple[int, int]] = [(0, 0)]
        while pos < size:
            m = self.TOKEN.match(text, pos)
            if not m:
                if hole and not stack and text[pos] == "!":
                    return pos
                break
            kind = m.lastgroup
            if kind == "id":
                t = m.group()
                if t in words:
                    add(code[t])
                else:
                    if not t.isascii() and not t.isidentifier():
                        raise SyntaxProblem("statement", "name")
                    add(ident)
            elif kind == "op":
                t = m.group()
                if t in "([{":
                    stack.append(t)
                    if len(stack) > MOST_BRACKETS:
                        raise SyntaxProblem("delimiter", "nesting")
                    add(t)
                elif t in ")]}":
                    if not stack:
                        if hole and t == "}":
                            return pos
                        raise SyntaxProblem("delimiter", "unopened " + t)
                    if self.closes[stack.pop()] != t:
                        raise SyntaxProblem("delimiter", "closed by " + t)
                    add(t)
                elif hole and not stack and (t in (":", ":=")):
                    return pos
                elif hole and not stack and t == "=" and re.compile(r"=\s*[!:}]").match(text, pos):
                    return pos
                else:
                    add(code[t])
            elif kind == "nl" or kind == "dent":
                if not stack and not hole:
                    if out and out[-1] != nl and out[-1] != DEDENT:
                        add(nl)
                    if m.end() < size:
                        self._indent(m.group("dent"), indents, add)
            elif kind == "num":
                if len(m.group()) > 4300 and m.group().replace("_", "").isdigit():
                    raise SyntaxProblem("literal", "number")
                add(code["num"])
            elif kind == "start" or kind == "quote":
                prefix = (m.group("prefix") or "").lower()
                if "f" in prefix:
                    pos = self._formatted(text, m.end(), m.group("quote"), "r" in prefix)
                    add(code["fstr"])
                    continue
                body = self.BODIES[m.group("quote")].match(text, m.end())
                if not body:
                    raise SyntaxProblem("literal", "string")
                self._escapes(body.group(), "r" in prefix, "b" in prefix)
                add(code["bytes" if "b" in prefix else "str"])
                pos = body.end()
                continue
            pos = m.end()
        if pos >= size:
            if hole:
                raise SyntaxProblem("literal", "string")
            if stack:
                raise SyntaxProblem("end", "open " + stack[-1])
            if out and out[-1] != nl and out[-1] != DEDENT:
                add(nl)
            out.extend(DEDENT * (len(indents) - 1))
        return pos

    def _indent(self, blanks: str, indents: list[tuple[int, int]], add) -> None:
        col = alt = 0
        for c in blanks.split("\\", 1)[0] if "\\" in blanks and blanks.split("\\", 1)[0] else blanks.replace("\\\n", ""):
            if c == " ":
                col, alt = col + 1, alt + 1
            elif c == "\t":
                col, alt = (col // 8 + 1) * 8, alt + 1
            elif c == "\f":
                col = alt = 0
        top = indents[-1]
        if col == top[0]:
            if alt != top[1]:
                raise SyntaxProblem("statement", "tabs")
        elif col > top[0]:
            if alt <= top[1]:
                raise SyntaxProblem("statement", "tabs")
            indents.append((col, alt))
            if len(indents) >= MOST_INDENTS:
                raise SyntaxProblem("statement", "indentation")
            add(INDENT)
        else:
            while col < indents[-1][0]:
                indents.pop()
                add(DEDENT)
            if col != indents[-1][0]:
                raise SyntaxProblem("statement", "indentation")
            if alt != indents[-1][1]:
                raise SyntaxProblem("statement", "tabs")

    def _escapes(self, body: str, raw: bool, binary: bool) -> None:
        if binary and not body.isascii():
            raise SyntaxProblem("literal", "bytes")
        if raw or "\\" not in body:
            return
        for m in self.ESCAPE.finditer(body):
            kind = body[m.start() + 1 : m.start() + 2]
            if kind == "x" and not m.group(1):
                raise SyntaxProblem("literal", "escape")
            if not binary:
                if kind == "u" and not m.group(2) or kind == "U" and (not m.group(3) or int(m.group(3), 16) > 0x10FFFF):
                    raise SyntaxProblem("literal", "escape")
                if kind == "N":
                    try:
                        unicodedata.lookup((m.group(4) or "{}")[1:-1])
                    except KeyError:
                        raise SyntaxProblem("literal", "escape") from None

    PLAIN = {q: re.compile(r"(?:[^{}\\" + q[0] + ("" if len(q) == 3 else r"\n") + r"]" + (f"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + r"|\{\{|\}\}|\\N\{[^}\n]*\}|\\(?=[{}])|\\(?s:[^{}]))*") for q in ('"', "'", '"""', "'''")}
    RAW = {q: re.compile(r"(?:[^{}\\" + q[0] + ("" if len(q) == 3 else r"\n") + r"]" + (f"|{q[0]}(?!{q[0] * 2})" if len(q) == 3 else "") + r"|\{\{|\}\}|\\(?=[{}])|\\(?s:[^{}]))*") for q in ('"', "'", '"""', "'''")}

    def _formatted(self, text: str, pos: int, quote: str, raw: bool) -> int:
        """The end of a formatted string whose opening ends before pos; its parts are checked."""
        plain = (self.RAW if raw else self.PLAIN)[quote]
        while True:
            m = plain.match(text, pos)
            self._escapes(m.group().replace("{{", " ").replace("}}", " "), raw, False)
            pos = m.end()
            if text.startswith(quote, pos):
                return pos + len(quote)
            if not text.startswith("{", pos):
                raise SyntaxProblem("literal", "string")
            pos = self._hole(text, pos + 1, quote, raw)

    def _hole(self, text: str, pos: int, quote: str, raw: bool, depth: int = 0) -> int:
        if depth > MOST_BRACKETS:
            raise SyntaxProblem("delimiter", "nesting")
        inner: list[str] = []
        pos = self._tokens(text, pos, inner, True)
        content = self.lambdas(self.tree("".join(inner)))
        if content is None or not self.interpolated.match(self._expressions(content, False)):
            raise SyntaxProblem("statement", "formatted part")
        if text.startswith("=", pos):
            pos = re.compile(r"=\s*").match(text, pos).end()
        if text.startswith("!", pos):
            m = re.compile(r"![rsa]\s*").match(text, pos)
            if not m:
                raise SyntaxProblem("statement", "conversion")
            pos = m.end()
        if text.startswith(":", pos):
            pos += 1
            spec = re.compile(r"[^{}" + quote[0] + ("" if len(quote) == 3 else r"\n") + "]*")
            while True:
                pos = spec.match(text, pos).end()
                if text.startswith("{", pos):
                    pos = self._hole(text, pos + 1, quote, raw, depth + 1)
                elif len(quote) == 3 and text.startswith(quote[0], pos) and not text.startswith(quote, pos):
                    pos += 1
                else:
                    break
        if not text.startswith("}", pos):
            raise SyntaxProblem("literal" if pos >= len(text) or text[pos] in "'\"\n" else "statement", "formatted part")
        return pos + 1

    def lambdas(self, content: str) -> str | None:
        """The content with each `lambda ...:` as one sign, from the last to the first, so that inner ones come first."""
        code = self.a.code
        word, colon, lam = code["lambda"], code[":"], code["lam"]
        at = content.rfind(word)
        while at >= 0:
            end = content.find(colon, at)
            if end < 0 or not self.lambda_params.match(self._listed(self._expressions(content[at + 1 : end], False))):
                return None
            content = content[:at] + lam + content[end + 1 :]
            at = content.rfind(word, 0, at)
        return content

    def _operand(self, m: re.Match) -> str:
        found = m.group()
        if len(found) == 1 and self.alone.match(found):
            return found
        return self.a.code["reach" if self.reaching.match(found) else "value"]

    def _merged(self, m: re.Match) -> str:
        return m.group() if len(m.group()) == 1 else self.a.code["value"]

    def _expressions(self, content: str, clauses: bool) -> str:
        """The content after the passes over expressions; clauses of comprehensions only stand in brackets."""
        code = self.a.code
        content = self.operands.sub(self._operand, content)
        if code["for"] in content:
            content = self.loops.sub(code["forin"], content)
        content = self.tests.sub(self._merged, content)
        if clauses and code["forin"] in content:
            content = self.clauses.sub(code["fors"], content)
        return self.choices.sub(self._merged, content) if code["else"] in content or code["lam"] in content else content

    def _statements(self, content: str) -> str:
        """The content of a block with one sign for each header and each line."""
        code = self.a.code
        if code["match"] in content:
            content = self.match_heads.sub(lambda m: code["subject"] if self.subject.match(self._expressions(m.group(1), False)) else m.group(), content)
        if code["case"] in content:
            content = self.case_heads.sub(code["pattern"], content)
        if code["type"] in content:
            content = self.type_heads.sub(code["alias"], content)
        content = self.headers.sub(code["header"], content)
        if code["import"] in content:
            content = self.imports.sub(code["imports"], content)
        return self.lines.sub(code["line"], self._expressions(content, False))

    def _listed(self, content: str) -> str:
        """With a comma after the last item."""
        comma = self.a.code[","]
        return content if not content or content[-1] == comma else content + comma

    def _reduce(self, opening: str, content: str) -> str:
        base = {"(": _ROUND, "[": _SQUARE, "{": _CURLY, INDENT: _BLOCK}[opening]
        plain = self.lambdas(content)
        if plain is None:
            return chr(base)
        if opening == INDENT:
            lines = self._statements(plain)
            return chr(base + bits([bool(self.block.match(lines)), bool(self.cases.match(lines))]))
        short = self._expressions(plain, True)
        comma = self.a.code[","]
        lone = short[-1:] != comma
        listed, raw = self._listed(short), self._listed(content)
        ok = lambda pattern, text=listed: bool(pattern.match(text))
        if opening == "[":
            return chr(base + bits([ok(self.index), ok(self.items) or lone and ok(self.generator, short), ok(self.targets), ok(self.deleted), ok(self.type_params), ok(self.patterns, raw)]))
        if opening == "{":
            return chr(base + bits([ok(self.pairs) or ok(self.items) or lone and (ok(self.generator, short) or ok(self.pair_generator, short)), ok(self.map_patterns, raw)]))
        many = not lone or comma in short
        return chr(base + bits([
            lone and ok(self.p_single, short) or many and ok(self.p_tuple), ok(self.args) or lone and ok(self.generator, short), ok(self.params), lone and ok(self.one_target, short) or (many or not short) and ok(self.targets),
            lone and ok(self.single, short), ok(self.deleted), ok(self.names), ok(self.with_items), ok(self.group_pattern, content) or (many or not short) and ok(self.patterns, raw), ok(self.class_patterns, raw),
        ]))

    def _whole(self, content: str) -> bool:
        plain = self.lambdas(content)
        return plain is not None and bool(self.file.match(self._statements(plain)))
