"""Lexers and pushdown reduction for JavaScript, Java and C.

A source text is lexed into one character per token. A stack then closes bracket
groups from the inside out: the flat token string inside a closed group is matched
against the language's patterns, and the group is replaced by one character that
says which roles it can play (argument list, block, object literal, ...). What is
left at the end has no brackets and must match the pattern of a whole file.
Reductions depend on the token string alone, so they are memoised.
"""

from __future__ import annotations

import re
from functools import lru_cache

_ROUND, _SQUARE, _CURLY = 0xE000, 0xE400, 0xE800
_WORD_BASE = 0x4E00
#: Results are remembered for token strings up to this length.
KEPT = 240


class SyntaxProblem(Exception):
    """A defect, with its kind: literal, delimiter, end, marker or statement."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(kind, detail)
        self.kind, self.detail = kind, detail


class Alphabet:
    """One character for every token text of a language, and patterns over them."""

    def __init__(self, words: str, signs: str, roles: dict[str, list[str]]):
        self.code = {w: chr(_WORD_BASE + k) for k, w in enumerate(words.split())}
        self.code |= {s: chr(_WORD_BASE + 0x400 + k) for k, s in enumerate(signs.split())}
        self.roles = roles
        self.names: dict[str, str] = {}
        for base, kind in ((_ROUND, "P"), (_SQUARE, "R"), (_CURLY, "B")):
            names = roles[kind]
            for k, role in enumerate(names):
                self.names[f"{kind}:{role}"] = "[" + "".join(chr(base + n) for n in range(1 << len(names)) if n >> k & 1) + "]"
            self.names[f"{kind}:*"] = f"[{chr(base)}-{chr(base + (1 << len(names)) - 1)}]"

    def define(self, name: str, text: str, **rest: str) -> None:
        self.names[name] = "(?:" + self.pattern(text) + ")"

    def pattern(self, text: str) -> str:
        """Quoted pieces and lower-case words are tokens, upper-case names are earlier
        patterns, P:x R:x B:x are groups in a role; all else is regular-expression syntax."""
        out = []
        for quoted, name, other in re.findall(r"'([^' ]+)'|([A-Za-z_]\w*(?::(?:\w+|\*))?)|(\S)", text):
            if quoted:
                out.append(self.code[quoted])
            elif name:
                out.append(self.code[name] if name in self.code else self.names[name])
            else:
                out.append(self.code[other] if other in ";," else other)
        return "".join(out)

    def compile(self, text: str) -> re.Pattern:
        return re.compile(self.pattern(text))

    def any_of(self, tokens: str) -> str:
        return "[" + "".join(self.code[t] for t in tokens.split()) + "]"


class Language:
    """Holds a lexer and the group patterns; `check` raises SyntaxProblem."""

    keep_newlines = False
    brackets = re.compile(r"[()\[\]{}]")
    closes = {"(": ")", "[": "]", "{": "}"}

    def __init__(self) -> None:
        self._reduce_short = lru_cache(maxsize=1 << 14)(self._reduce)
        self._whole_short = lru_cache(maxsize=1 << 12)(self._whole)

    def reduce(self, opening: str, content: str) -> str:
        """Only short contents are kept, so that the caches stay within some megabytes."""
        return (self._reduce_short if len(content) <= KEPT else self._reduce)(opening, content)

    def whole(self, content: str) -> bool:
        return (self._whole_short if len(content) <= KEPT else self._whole)(content)

    def lex(self, text: str) -> str:
        raise NotImplementedError

    def _reduce(self, opening: str, content: str) -> str:
        raise NotImplementedError

    def _whole(self, content: str) -> bool:
        raise NotImplementedError

    def ternaries(self, content: str) -> str:
        """Matched `?` and `:` become operators of their own, so that an expression is a chain."""
        code = self.a.code
        ask, colon = code["?"], code[":"]
        if ask not in content:
            return content
        out, open_at = list(content), []
        for k, c in enumerate(content):
            if c == ask:
                open_at.append(k)
            elif c == colon and open_at:
                out[open_at.pop()], out[k] = code["ask"], code["or"]
        return "".join(out)

    def unpaired(self, content: str) -> bool:
        """An `else` or `do` that no `if` or `while` of the same statement list can own."""
        code = self.a.code
        return content.count(code["else"]) > content.count(code["if"]) or content.count(code["do"]) > content.count(code["while"])

    def tree(self, tokens: str) -> str:
        """The bracket-free token string of the whole file."""
        out: list[str] = []
        stack: list[tuple[str, list[str]]] = []
        pos = 0
        for m in self.brackets.finditer(tokens):
            k = m.start()
            if k > pos:
                out.append(tokens[pos:k])
            pos = k + 1
            c = tokens[k]
            if c in self.closes:
                stack.append((c, out))
                out = []
            else:
                if not stack:
                    raise SyntaxProblem("delimiter", "unopened " + c)
                opening, outer = stack.pop()
                if self.closes[opening] != c:
                    raise SyntaxProblem("delimiter", opening + " closed by " + c)
                outer.append(self.reduce(opening, "".join(out)))
                out = outer
        if stack:
            raise SyntaxProblem("end", "open " + stack[-1][0])
        out.append(tokens[pos:])
        return "".join(out)

    def check(self, text: str) -> None:
        if not self.whole(self.tree(self.lex(text))):
            raise SyntaxProblem("statement")


MARKER = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M)


def bits(checks: list[bool]) -> int:
    return sum(1 << k for k, on in enumerate(checks) if on)


# --------------------------------------------------------------------------- JavaScript

_JS_WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if "
    "import in instanceof new return super switch this throw try typeof var void while with null true false enum "
    "async await of let static get set yield"
)
_JS_SIGNS = (
    "ident num str tpl regex private nl ask or ; , : ? ?. . ... => = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= "
    "== === != !== < > <= >= << >> >>> + - * / % ** ++ -- & | ^ && || ?? ! ~ @ #"
)


class JavaScript(Language):
    """ECMAScript scripts (not modules)."""

    keep_newlines = True

    def __init__(self) -> None:
        super().__init__()
        a = self.a = Alphabet(_JS_WORDS, _JS_SIGNS, {
            "P": ["expr", "args", "params", "loop", "ret"],
            "R": ["index", "array", "target"],
            "B": ["block", "object", "target", "body", "cases", "ret"],
        })
        d = a.define
        word_chars = "".join(a.code[w] for w in _JS_WORDS.split())
        soft = "async of let static get set yield await"
        a.names["ID"] = "[" + a.code["ident"] + "".join(a.code[w] for w in soft.split()) + "]"
        a.names["NAME"] = "[" + a.code["ident"] + word_chars + "]"
        a.names["BIN"] = a.any_of("== === != !== < > <= >= << >> >>> + - * / % ** & | ^ && || ?? in instanceof = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= ask or")
        a.names["ASG"] = a.any_of("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=")
        d("FUNC", "async? function '*'? ID? P:params B:block")
        d("LAMBDA", "async? (?:P:params|ID) '=>'")
        d("PRE", "(?:yield '*'|[" + "".join(a.code[t] for t in "! ~ + - ++ -- typeof void delete await yield new".split()) + "]|LAMBDA(?!B:block))")
        d("CLASS", "class ID? (?: extends (?:ID|P:expr)(?:'.' NAME|P:args)* )? B:body")
        d("PRIM", "(?:LAMBDA B:block|FUNC|CLASS|ID|num|str|tpl|regex|this|null|true|false|super|P:expr|R:array|B:object|import P:args|import '.' NAME|new '.' NAME|private(?=in))")
        d("POST", "(?:'.' (?:NAME|private)|'?.'(?:NAME|private|P:args|R:index)|P:args|R:index|tpl)*+(?:'++'|'--')?")
        d("OPER", "(?>PRE*+ PRIM POST)")
        a.names["BINC"] = a.names["BIN"][:-1] + a.code[","] + "]"
        d("C3", "(?>OPER(?:BIN OPER)*+)")
        d("EXPRS", "(?>OPER(?:BINC OPER)*+)")
        d("BIND", "(?:ID|R:target|B:target)")
        d("PARAM", "BIND(?:'=' C3)?")
        d("VARS", "(?:[var let const](?:(?:(?<=[var let const])|,) BIND(?:'=' C3)?)++)")
        d("END", "(?:nl*+ ;|nl++|(?=$)|(?=case|default))")
        d("HEAD", "(?:(?:while P:expr|for await? P:loop|with P:expr|ID ':'|if P:expr|else|do) nl*+)")
        d("STOP", "(?:VARS|return EXPRS?|throw EXPRS|(?:break|continue) ID?|debugger|EXPRS) END")
        d("TRY", "try B:block nl*+ (?:catch (?:P:params)? B:block nl*+ (?:finally B:block)?|finally B:block)")
        d("FUND", "async? function '*'? ID P:params B:block")
        d("CLSD", "class ID (?: extends (?:ID|P:expr)(?:'.' NAME|P:args)* )? B:body")
        d("STMT", "(?>HEAD*+ (?:;|FUND|CLSD|TRY|switch P:expr B:cases|B:block|(?!B:*)STOP|(?<=while P:expr)(?=$)|(?<=while P:expr nl)) nl*+)")
        self.const = a.compile("const (?:BIND(?:'=' C3)?,)*+ BIND(?!'=')")
        self.block = a.compile("nl*+ STMT*+ $")
        self.cases = a.compile("nl*+ (?:(?:case EXPRS|default) ':' nl*+ STMT*+)*+ $")
        d("KEY", "(?:NAME|num|str|private|R:index)")
        d("METHOD", "(?:(?:async|get|set) nl*+)?'*'? KEY P:params B:block")
        d("PROP", "(?>METHOD|KEY ':' C3|ID(?:'=' C3)?|'...' C3)")
        self.object = a.compile("(?:PROP(?:, PROP)*+ ,?)? $")
        d("TPROP", "(?:KEY ':' (?:BIND|OPER)(?:'=' C3)?|ID(?:'=' C3)?|'...' OPER)")
        self.target_object = a.compile("(?:TPROP(?:',' TPROP)*+ ','?)? $")
        d("MEMBER", "(?>(?:static nl*+)?METHOD|static B:block|(?:static nl*+)?KEY(?:'=' C3)?(?=;|nl|$)|;|nl)")
        self.body = a.compile("MEMBER*+ $")
        self.expr = a.compile("EXPRS $")
        self.args = a.compile("(?:'...'? C3 (?:',' '...'? C3)*+ ','?)? $")
        self.params = a.compile("(?:PARAM(?:',' PARAM)*+ (?:',' '...' BIND|','?)|'...' BIND)? $")
        self.loop_const = a.compile("const (?:BIND(?:'=' C3)?,)*+ BIND(?!['=' in of])")
        self.loop = a.compile("(?:(?:VARS|EXPRS)? ; EXPRS? ; EXPRS?|(?:(?:var|let|const) BIND|OPER)(?:in EXPRS|of C3)) $")
        self.array = a.compile(",*+ (?:'...'? C3 (?:,++ '...'? C3)*+)? ,*+ $")
        self.target_array = a.compile("','*+(?:'...'? (?:BIND|OPER)(?:'=' C3)?(?:','++ '...'? (?:BIND|OPER)(?:'=' C3)?)*+)? ','*+ $")
        bits = len(a.roles["B"])
        ret = {chr(_CURLY + n): chr(_CURLY + (n & ~(1 << (bits - 1)))) for n in range(1 << bits) if n >> (bits - 1) & 1}
        self._ret_chars = re.compile("[" + "".join(ret) + a.code["return"] + "]")
        self._ret_map = str.maketrans(ret)
        self._own_ret = a.compile("(?:(?:function '*'? ID? P:params|'=>') B:ret)")
        self._method_ret = a.compile("(?:P:params B:ret|static B:ret)")
        self._bad_target = re.compile("(?:" + "|".join([
            a.pattern("(?:num|str|regex|this|null|true|false|tpl)ASG"),
            a.pattern("(?:NAME|R:*|P:*)P:*ASG"),
        ]) + ")")
        stop = "".join(a.code[t] for t in "ident num str tpl regex ++ -- this null true false super break continue return debugger private async of let static get set yield await default do".split())
        group = f"{chr(_ROUND)}-{chr(_CURLY + 0x3FF)}"
        go = "".join(a.code[t] for t in "ident num str regex ++ -- ! ~ private @ #".split()) + "".join(a.code[w] for w in _JS_WORDS.split() if w not in ("in", "instanceof"))
        nl = a.code["nl"]
        self._asi = re.compile(f"(?<![{stop}{group}]){nl}+|{nl}+(?![{go}-{chr(_CURLY)}-{chr(_CURLY + 0x3FF)}{nl}])")
        self._prev_operand = set(stop) - {a.code[w] for w in "return default do".split()}

    TOKEN = re.compile(
        r"""(?P<ws>[^\S\n\r\u2028\u2029]+)|(?P<nl>[\n\r\u2028\u2029])|(?P<com>//[^\n\r\u2028\u2029]*|/\*(?s:.*?)\*/)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"""
        r"""|(?P<num>(?:0[xX][\da-fA-F][\da-fA-F_]*|0[bB][01][01_]*|0[oO][0-7][0-7_]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))"""
        r"""|(?P<str>'(?:[^'\\\n\r]|\\(?s:.))*'|"(?:[^"\\\n\r]|\\(?s:.))*")|(?P<tpl>`)"""
        r"""|(?P<op>(?!/\*)(?:>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.@()\[\]{}]))"""
        r"""|(?P<priv>\#[A-Za-z_$][\w$]*)"""
    )
    WORDS = frozenset(_JS_WORDS.split())
    REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")

    def lex(self, text: str) -> str:
        out: list[str] = []
        pos = (text.index("\n") if "\n" in text else len(text)) if text.startswith("#!") else 0
        if text.startswith("\ufeff"):
            pos = 1
        self._scan(text, pos, out, False)
        return "".join(out)

    def _scan(self, text: str, pos: int, out: list[str], hole: bool) -> int:
        """Lexes from pos to the end, or in a part of a template to the brace that ends it; gives the place after."""
        code, add, size, depth = self.a.code, out.append, len(text), 0
        while pos < size:
            restart = None
            for m in self.TOKEN.finditer(text, pos):
                if m.start() != pos:
                    break
                kind = m.lastgroup
                if kind == "ws":
                    pass
                elif kind == "id":
                    add(code.get(m.group(), code["ident"]) if m.group() in self.WORDS else code["ident"])
                elif kind == "op":
                    t = m.group()
                    if hole and t in "{}":
                        if t == "}" and not depth:
                            return pos
                        depth += 1 if t == "{" else -1
                    if t in ("/", "/=") and not (out and (out[-1] in self._prev_operand or out[-1] in ")]}")):
                        r = self.REGEX.match(text, pos)
                        if not r:
                            raise SyntaxProblem("literal", "regular expression")
                        add(code["regex"])
                        restart = r.end()
                        break
                    add(t if t in "()[]{}" else code[t])
                elif kind == "nl":
                    add(code["nl"])
                elif kind == "com":
                    if "\n" in m.group():
                        add(code["nl"])
                elif kind == "str":
                    add(code["str"])
                elif kind == "num":
                    add(code["num"])
                elif kind == "tpl":
                    restart = self._template(text, m.end())
                    add(code["tpl"])
                    break
                else:
                    add(code["private"])
                pos = m.end()
            if restart is None:
                if pos < size:
                    self._stuck(text, pos)
                break
            pos = restart
        if hole:
            raise SyntaxProblem("literal", "template")
        return pos

    @staticmethod
    def _stuck(text: str, pos: int) -> None:
        c = text[pos]
        if c in "'\"":
            raise SyntaxProblem("literal", "string")
        if text.startswith("/*", pos):
            raise SyntaxProblem("literal", "comment")
        raise SyntaxProblem("statement", "sign " + c)

    def _template(self, text: str, pos: int) -> int:
        """The end of a template literal whose backtick ends before pos; its parts are checked."""
        size = len(text)
        while pos < size:
            c = text[pos]
            if c == "`":
                return pos + 1
            if c == "\\":
                pos += 2
            elif c == "$" and text.startswith("${", pos):
                inner: list[str] = []
                pos = self._scan(text, pos + 2, inner, True) + 1
                if self.reduce("(", self.tree("".join(inner))) not in self._expr_chars:
                    raise SyntaxProblem("statement", "template part")
            else:
                pos += 1
        raise SyntaxProblem("literal", "template")

    @property
    def _expr_chars(self) -> str:
        return self.a.names["P:expr"]

    def _flat(self, content: str) -> str:
        """Without newlines."""
        return content.replace(self.a.code["nl"], "")

    def _lines(self, content: str) -> str:
        """Newlines stay only where they can end a statement."""
        return self._asi.sub("", content)

    def _reduce(self, opening: str, content: str) -> str:
        content = self.ternaries(content)
        flat = self._flat(content)
        good = not self._bad_target.search(flat)
        if opening == "(":
            return chr(_ROUND + bits([good and bool(self.expr.match(flat)), good and bool(self.args.match(flat)), bool(self.params.match(flat)), good and bool(self.loop.match(flat)) and not self.loop_const.search(flat)]))
        if opening == "[":
            return chr(_SQUARE + bits([good and bool(self.expr.match(flat)), good and bool(self.array.match(flat)), bool(self.target_array.match(flat))]))
        lines = self._lines(content)
        good = good and not self.unpaired(content) and not self.const.search(flat)
        free = bool(self._ret_chars.search(self._own_ret.sub("", lines)))
        inner = bool(self._ret_chars.search(self._method_ret.sub("", self._own_ret.sub("", flat))))
        block = good and bool(self.block.match(lines))
        return chr(_CURLY + bits([
            block, good and not inner and bool(self.object.match(flat)), bool(self.target_object.match(flat)),
            good and not inner and bool(self.body.match(lines)), good and bool(self.cases.match(lines)), free if block else inner,
        ]))

    def _whole(self, content: str) -> bool:
        content = self.ternaries(content)
        lines, flat = self._lines(content), self._flat(content)
        if self._bad_target.search(flat) or self.unpaired(content) or self.const.search(flat) or self._ret_chars.search(self._own_ret.sub("", lines)):
            return False
        return bool(self.block.match(lines))


# --------------------------------------------------------------------------- Java

_JAVA_WORDS = (
    "abstract assert break case catch class continue default do else enum extends final finally for if implements import "
    "instanceof interface native new null package private protected public return static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false goto const yield record sealed permits non"
)
_JAVA_SIGNS = (
    "ident prim num str chr generic ask or ; , : ? . ... -> :: @ = += -= *= /= %= &= |= ^= <<= == != < > <= >= << + - * / % ++ -- & | ^ && || ! ~"
)


class Java(Language):
    """Java 17 compilation units."""

    def __init__(self) -> None:
        super().__init__()
        a = self.a = Alphabet(_JAVA_WORDS, _JAVA_SIGNS, {
            "P": ["expr", "args", "type", "params", "loop", "catch", "open", "lambda", "note"],
            "R": ["empty", "index"],
            "B": ["block", "array", "body", "cases", "enum"],
        })
        d = a.define
        soft = "yield record sealed permits non"
        a.names["ID"] = "[" + a.code["ident"] + "".join(a.code[w] for w in soft.split()) + "]"
        d("QN", "ID(?:'.' ID)*+")
        d("NOTE", "(?:'@' QN (?:P:note)?)")
        d("TYPE", "(?>NOTE*+(?:ID generic?(?:'.' NOTE*+ ID generic?)*+|prim)(?:NOTE*+ R:empty)*+)")
        d("NODIM", "(?>NOTE*+(?:ID generic?(?:'.' ID generic?)*+|prim))")
        d("ARG", "(?:NOTE*+(?:'?'(?:(?:extends|super) TYPE)?|TYPE(?:extends TYPE(?:'&' TYPE)*+)?))")
        self.generic = a.compile("'<'(?:ARG(?:, ARG)*+)?'>'")
        d("TYPES", "(?:TYPE(?:, TYPE)*+)")
        shifts = "'<<'|'>' '>' '>'|'>' '>'"
        a.names["OPC"] = a.any_of("== != < > <= >= + - * / % & | ^ && || ask or")
        a.names["ASC"] = a.any_of("= += -= *= /= %= &= |= ^= <<=")
        d("ASG", "(?:ASC|'>' '>' '>='|'>' '>=')")
        d("BIN", f"(?:{shifts}|OPC)")
        d("LAMBDA", "(?:(?:P:lambda|ID) '->')")
        d("CAST", "(?:P:type(?=[" + "".join(a.code[t] for t in "ident num str chr ! ~ this super new null true false prim switch".split()) + "".join(a.code[w] for w in soft.split()) + f"{chr(_ROUND)}-{chr(_SQUARE - 1)}" + "]))")
        d("PRE", "(?:['+' '-' '++' '--' '!' '~']|CAST|LAMBDA(?!B:block))")
        d("NEW", "(?:new NODIM(?:P:args (?:B:body)?|R:index++ R:empty*+|R:empty++ B:array))")
        d("PRIM", "(?:LAMBDA B:block|NEW|TYPE '::' (?:new|ID)|(?:prim|void) R:empty*+ '.' class|NODIM R:empty++ '.' class|ID|num|str|chr|null|true|false|this|super|P:expr|switch P:expr B:cases)")
        d("POST", "(?:'.' (?:ID|this|class|super|NEW|generic ID|generic super)|P:args|R:index|'::' generic?(?:ID|new))*+(?:'++'|'--')?")
        d("OPER", "(?>PRE*+ PRIM POST)(?:instanceof final? TYPE ID?)?")
        d("EXPR", "(?>OPER(?:(?:ASG|BIN) OPER)*+)")
        d("EXPRS", "(?>OPER(?:(?:ASG|BIN|,) OPER)*+)")
        d("INIT", "(?:B:array|EXPR)")
        lasts = f"[{chr(_ROUND)}-{chr(_ROUND + 0x1FF)}{a.code['++']}{a.code['--']}{chr(_CURLY)}-{chr(_CURLY + 0x3F)}]"
        a.names["LASTS"] = f"(?<={lasts})"
        d("ACT", "(?>['++' '--'] PRIM POST|(?!P:*(?:;|,|$)) PRIM POST(?:ASG EXPR|LASTS))")
        d("MOD", "(?:NOTE|public|protected|private|static|abstract|final|native|synchronized|transient|volatile|strictfp|default|sealed|non '-' sealed)")
        d("DECL", "ID R:empty*+ (?:'=' INIT)?")
        d("VARS", "(?:(?:final|NOTE)*+ TYPE DECL(?:, DECL)*+)")
        d("CLSB", "(?:class ID generic?(?:extends TYPE)?(?:implements TYPES)?(?:permits TYPES)? B:body|interface ID generic?(?:extends TYPES)?(?:permits TYPES)? B:body|enum ID(?:implements TYPES)? B:enum|record ID generic? P:params(?:implements TYPES)? B:body|'@' interface ID B:body)")
        d("TDEC", "(?>MOD*+ CLSB)")
        d("HEAD", "(?:while P:expr|for P:loop|ID ':'|if P:expr|else|do)")
        d("TRY", "try (?:P:open B:block(?:catch P:catch B:block)*+(?:finally B:block)?|B:block(?:(?:catch P:catch B:block)++(?:finally B:block)?|finally B:block))")
        d("BASE", "(?>;|B:block|TRY|switch P:expr B:cases|synchronized P:expr B:block|(?:return EXPR?|(?:throw|yield) EXPR|(?:break|continue) ID?|assert EXPR(?:':' EXPR)?|ACT) ;)")
        d("STMT", "(?>(?:final|abstract|static|strictfp|NOTE)*+ CLSB|VARS ;|HEAD*+ BASE)")
        self.block = a.compile("(?:(?:this|super|ID '.' super)P:args ;)? STMT*+ $")
        self.cases = a.compile("(?:(?:(?:case EXPRS|case null(?:, default)?|default) ':')++ STMT*+)*+ $|(?:(?:case EXPRS|default) '->' (?:B:block|throw EXPR ;|EXPR ;))*+ $")
        d("THROWS", "(?:throws TYPES)?")
        d("MEMBER", "(?>;|static? B:block|TDEC|MOD*+ generic?(?:(?:TYPE|void) ID P:params R:empty*+ THROWS(?:B:block|(?:default (?:INIT|NOTE))? ;)|ID P:params THROWS B:block|ID B:block)|MOD*+ TYPE DECL(?:, DECL)*+ ;)")
        self.body = a.compile("MEMBER*+ $")
        self.enum = a.compile("(?:NOTE*+ ID(?:P:args)?(?:B:body)?(?:, NOTE*+ ID(?:P:args)?(?:B:body)?)*+)?,?(?:; MEMBER*+)? $")
        self.array = a.compile("(?:INIT(?:, INIT)*+ ,?)? $|, $")
        d("PARAM", "(?:(?:final|NOTE)*+ TYPE(?:NOTE*+ '...')?(?:ID(?:'.' this)? R:empty*+|this))")
        self.forms = [
            a.compile("EXPR $"), a.compile("EXPRS? $"), a.compile("TYPE(?:'&' TYPE)*+ $"), a.compile("(?:PARAM(?:, PARAM)*+)? $"),
            a.compile("(?:(?:VARS|ACT(?:, ACT)*+)? ; EXPR? ; (?:ACT(?:, ACT)*+)?|(?:final|NOTE)*+ TYPE ID R:empty*+ ':' EXPR) $"),
            a.compile("(?:final|NOTE)*+ TYPE(?:'|' TYPE)*+ ID $"),
            a.compile("(?:VARS|QN)(?:; (?:VARS|QN))*+ ;? $"),
            a.compile("(?:ID(?:, ID)*+|PARAM(?:, PARAM)*+)? $"),
            a.compile("(?:(?:ID '=')?(?:INIT|NOTE)(?:, (?:ID '=')?(?:INIT|NOTE))*+)? $"),
        ]
        self.index = a.compile("EXPR $")
        self.unit = a.compile("(?:NOTE*+ package QN ; )?(?:;|import static? QN(?:'.' '*')? ;)*+(?:;|TDEC)*+ $")

    TOKEN = re.compile(
        r"""(?P<ws>[ \t\f\r\n]+|//[^\n\r]*|/\*(?s:.*?)\*/)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"""
        r"""|(?P<num>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))"""
        r"""|(?P<str>\"{3}[ \t\f]*\r?\n(?:[^\\"]|\\(?s:.)|"(?!""))*\"{3}|"(?:[^"\\\n\r]|\\(?:[btnfrs0-7"'\\]|u+[\da-fA-F]{4}))*")"""
        r"""|(?P<chr>'(?:[^'\\\n\r]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))')"""
        r"""|(?P<op>(?!/\*)(?:\.\.\.|->|::|<<=|\+\+|--|&&|\|\||==|!=|<=|>=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.@()\[\]{}]))"""
    )
    PRIMS = frozenset("int long short byte char boolean float double".split())
    WORDS = frozenset(_JAVA_WORDS.split())

    def lex(self, text: str) -> str:
        code = self.a.code
        out: list[str] = []
        add = out.append
        pos = 0
        for m in self.TOKEN.finditer(text):
            if m.start() != pos:
                break
            pos = m.end()
            kind = m.lastgroup
            if kind == "ws":
                continue
            t = m.group()
            if kind == "id":
                add(code[t] if t in self.WORDS else code["prim"] if t in self.PRIMS else code["ident"])
            elif kind == "op":
                add(t if t in "()[]{}" else code[t])
            else:
                add(code[kind])
        if pos < len(text):
            if text[pos] in "'\"":
                raise SyntaxProblem("literal", "string")
            if text.startswith("/*", pos):
                raise SyntaxProblem("literal", "comment")
            if text[pos:] != "\x1a":
                raise SyntaxProblem("statement", "sign " + text[pos])
        return "".join(out)

    def _reduce(self, opening: str, content: str) -> str:
        ways = self._ways(content)
        if opening == "(":
            return chr(_ROUND + bits([any(f.match(w) for w in ways) for f in self.forms]))
        if opening == "[":
            return chr(_SQUARE + bits([not content, any(self.index.match(w) for w in ways)]))
        return chr(_CURLY + bits([any(p.match(w) for w in ways) and not (k in (0, 3) and self.unpaired(content)) for k, p in enumerate((self.block, self.array, self.body, self.cases, self.enum))]))

    def _ways(self, content: str) -> list[str]:
        """The content with type arguments as one token each, and as it stands if that differs.

        Type arguments come first: their `?` is no operator."""
        short, n = content, 1
        while n:
            short, n = self.generic.subn(self.a.code["generic"], short)
        return [self.ternaries(x) for x in ([short, content] if short != content else [content])]

    def _whole(self, content: str) -> bool:
        return bool(self.unit.match(self._ways(content)[0]))


# --------------------------------------------------------------------------- C

_C_WORDS = (
    "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static "
    "struct switch typedef union volatile while _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local"
)
_C_SIGNS = (
    "ident prim num str chr ask or ; , : ? . ... -> = += -= *= /= %= &= |= ^= <<= >>= == != < > <= >= << >> + - * / % ++ -- & | ^ && || ! ~"
)


class C(Language):
    """C11 translation units; directives are checked by name and nesting, not expanded.

    A unit without declarations, such as comments alone, passes, as it does in compilers.
    """

    def __init__(self) -> None:
        super().__init__()
        a = self.a = Alphabet(_C_WORDS, _C_SIGNS, {
            "P": ["expr", "args", "type", "params", "loop", "decl", "abs", "assert", "generic"],
            "R": ["any"],
            "B": ["block", "init", "fields", "enum"],
        })
        d = a.define
        d("QUAL", "(?:const|volatile|restrict|_Atomic)")
        d("STORE", "(?:static|extern|typedef|register|auto|inline|_Noreturn|_Thread_local|_Alignas P:*)")
        d("TAG", "(?:(?:struct|union)(?:ident(?:B:fields)?|B:fields)|enum (?:ident(?:B:enum)?|B:enum)|_Atomic P:type)")
        d("SPEC", "(?>(?:QUAL|STORE)*+(?:prim(?:prim|QUAL|STORE)*+|(?:TAG|ident)(?:QUAL|STORE)*+))")
        d("STAR", "(?:'*' QUAL*+)")
        d("DECR", "(?>STAR*+(?:ident|P:decl)(?:R:any|P:params)*+)")
        d("ABS", "(?>STAR*+(?:P:abs)?(?:R:any|P:params)*+)")
        d("TYPE", "(?>(?:QUAL)*+(?:prim(?:prim|QUAL)*+|(?:TAG|ident)QUAL*+) ABS)")
        a.names["OPS"] = a.any_of("== != < > <= >= << >> + - * / % & | ^ && || = += -= *= /= %= &= |= ^= <<= >>= ask or")
        d("PRE", "(?:['&' '*' '+' '-' '!' '~' '++' '--']|sizeof(?!P:type)|sizeof(?=P:expr)|P:type(?=[" + "".join(a.code[t] for t in "ident num str chr sizeof & * + - ! ~ ++ --".split()) + f"{chr(_ROUND)}-{chr(_SQUARE - 1)}" + "]))")
        d("PRIM", "(?:(?:sizeof|_Alignof) P:type|P:type B:init|ident|num|str++|chr|P:expr|_Generic P:generic)")
        d("POST", "(?:R:any|P:args|['.' '->'] ident|'++'|'--')*+")
        d("OPER", "(?>PRE* PRIM POST)")
        d("EXPR", "(?>OPER(?:OPS OPER)*+)")
        d("EXPRS", "(?>OPER(?:(?:OPS|,) OPER)*+)")
        d("INIT", "(?:B:init|EXPR)")
        d("BITS", "(?:':' EXPR)?")
        d("ITEM", "DECR(?:'=' INIT)?")
        d("DECL", "(?>SPEC(?:ITEM(?:, ITEM)*+)? ;|_Static_assert P:assert ;)")
        d("HEAD", "(?:while P:expr|for P:loop|switch P:expr|ident ':'|case EXPR ':'|default ':'|if P:expr|else|do)")
        d("STMT", "(?>HEAD*+ (?:;|B:block|(?:return EXPRS?|break|continue|goto ident|EXPRS) ;|DECL))")
        self.block = a.compile("STMT*+ $")
        d("DESIG", "(?:(?:R:any|'.' ident)++ '=')?")
        self.init = a.compile("(?:DESIG INIT(?:, DESIG INIT)*+ ,?)? $")
        d("FIELD", "(?>SPEC(?:(?:DECR BITS|BITS)(?:, (?:DECR BITS|BITS))*+)? ;|_Static_assert P:assert ;|;)")
        self.fields = a.compile("FIELD*+ $")
        self.enum = a.compile("ident(?:'=' EXPR)?(?:, ident(?:'=' EXPR)?)*+ ,? $")
        d("PARAM", "(?:SPEC(?:DECR|ABS))")
        self.forms = [
            a.compile("EXPRS $"), a.compile("(?:EXPR(?:, EXPR)*+|TYPE(?:, EXPR)*+|EXPR, TYPE(?:, EXPR)*+)? $"), a.compile("TYPE $"),
            a.compile("(?:PARAM(?:, PARAM)*+(?:, '...')?|ident(?:, ident)*+)? $"),
            a.compile("(?:DECL EXPRS? ; EXPRS?|EXPRS? ; EXPRS? ; EXPRS?) $"),
            a.compile("DECR $"), a.compile("(?:STAR++(?:P:abs)?(?:R:any|P:params)*+|P:abs(?:R:any|P:params)*+|(?:R:any|P:params)++) $"),
            a.compile("EXPR, str++ $"), a.compile("EXPR(?:, (?:TYPE|default) ':' EXPR)++ $"),
        ]
        self.index = a.compile("(?:static|QUAL)*+(?:EXPR|'*')? $")
        self.unit = a.compile("(?>SPEC? STAR*+(?:ident|P:decl)(?:R:any|P:params)*+(?<=" + a.names["P:params"] + ")DECL*+ B:block|DECL|;)*+ $")

    TOKEN = re.compile(
        r"""(?P<ws>[ \t\f\v\r\n]+|//[^\n]*|/\*(?s:.*?)\*/)|(?P<id>[^\W\d]\w*)"""
        r"""|(?P<num>(?:0[xX](?:[\da-fA-F]+\.?[\da-fA-F]*|\.[\da-fA-F]+)(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfF]*)(?![\w.]))"""
        r"""|(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*")|(?P<chr>[uUL]?'(?:[^'\\\n]|\\.)+')"""
        r"""|(?P<op>(?!/\*)(?:\.\.\.|->|<<=|>>=|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=?:;,.()\[\]{}]))"""
    )
    PRIMS = frozenset("void char short int long float double signed unsigned _Bool _Complex _Imaginary".split())
    WORDS = frozenset(_C_WORDS.split())
    DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\n\\]|\\\r?\n|\\.)*)", re.M)
    DIRECTIVES = frozenset("include define undef if ifdef ifndef elif else endif line error pragma warning".split())
    COMMENT = re.compile(r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")

    def directives(self, text: str) -> str:
        """The text without its directive lines; names and nesting are checked."""
        if "#" not in text:
            return text
        depth = 0
        hidden = {m.start() for m in self.DIRECTIVE.finditer(text)}
        if "/*" in text:
            for m in self.COMMENT.finditer(text):
                if "\n" in m.group():
                    hidden -= {k for k in hidden if m.start() < k < m.end()}

        def drop(m: re.Match) -> str:
            nonlocal depth
            if m.start() not in hidden:
                return m.group()
            name, rest = m.group(1), m.group(2)
            if name and name not in self.DIRECTIVES or not name and rest.strip():
                raise SyntaxProblem("statement", "directive")
            if name == "include" and not re.match(r"\s*(?:<[^>\n]+>|\"[^\"\n]+\"|\w+)", rest):
                raise SyntaxProblem("literal" if re.match(r'\s*[<"]', rest) else "statement", "include")
            if name in ("define", "undef", "ifdef", "ifndef") and not re.match(r"\s+[^\W\d]\w*", rest):
                raise SyntaxProblem("statement", "directive")
            depth += name.startswith("if")
            if name in ("elif", "else", "endif") and depth < 1:
                raise SyntaxProblem("delimiter", "directive")
            depth -= name == "endif"
            return ""

        text = self.DIRECTIVE.sub(drop, text)
        if depth:
            raise SyntaxProblem("end", "directive")
        return text

    def lex(self, text: str) -> str:
        code = self.a.code
        text = self.directives(text)
        if "\\\n" in text:
            text = text.replace("\\\n", "")
        out: list[str] = []
        add = out.append
        pos = 0
        for m in self.TOKEN.finditer(text):
            if m.start() != pos:
                break
            pos = m.end()
            kind = m.lastgroup
            if kind == "ws":
                continue
            t = m.group()
            if kind == "id":
                add(code[t] if t in self.WORDS else code["prim"] if t in self.PRIMS else code["ident"])
            elif kind == "op":
                add(t if t in "()[]{}" else code[t])
            else:
                add(code[kind])
        if pos < len(text):
            if text[pos] in "'\"":
                raise SyntaxProblem("literal", "string")
            if text.startswith("/*", pos):
                raise SyntaxProblem("literal", "comment")
            raise SyntaxProblem("statement", "sign " + text[pos])
        return "".join(out)

    def _reduce(self, opening: str, content: str) -> str:
        content = self.ternaries(content)
        if opening == "(":
            return chr(_ROUND + bits([bool(f.match(content)) for f in self.forms]))
        if opening == "[":
            return chr(_SQUARE + bits([bool(self.index.match(content))]))
        return chr(_CURLY + bits([not self.unpaired(content) and bool(self.block.match(content)), *(bool(p.match(content)) for p in (self.init, self.fields, self.enum))]))

    def _whole(self, content: str) -> bool:
        return bool(self.unit.match(self.ternaries(content)))
