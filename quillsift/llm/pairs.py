"""Problem 1: defective instruction and answer pairs, by ordered rules."""

from __future__ import annotations

import json
import re
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.grammar import MARKER, SyntaxProblem
from quillsift.llm.syntax import grammar_of, parses, problem_kind, python_problem
from quillsift.llm.values import WORD, is_empty, language_name, map_batches, words
from quillsift.session import spread

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")

# Phrases of refusal by language (fixed values, matched in lower case with straight apostrophes).
REFUSALS = [
    # English
    r"\bi(?:'m| am)?(?: (?:really|very|so|truly))? (?:sorry|afraid)\b.{0,40}\b(?:not|n't|unable|cannot)", r"\bi (?:can(?:no|')t|can not|won't|will not|could not|am (?:unable|not able|not allowed|not permitted|not comfortable)|must (?:decline|refuse|not)|have to (?:decline|refuse)|decline|refuse)\b",
    r"\bi'm (?:unable|not able|not allowed|not permitted|not comfortable|not going)\b", r"\b(?:not|n't) (?:be )?(?:appropriate|ethical|possible|right|responsible) (?:for me|to)\b", r"\bagainst (?:my|our|the) (?:guidelines|polic|principles|rules|programming|ethic)", r"\bas an? (?:ai|artificial intelligence|assistant|language model)\b.{0,40}\b(?:not|n't|unable|cannot|decline)",
    r"\b(?:unable|not able) to (?:help|assist|provide|share|write|create|comply|produce|implement|fulfil|answer|support)", r"\bcan(?:no|')t (?:help|assist|provide|share|write|create|comply|produce|implement|fulfil|answer|support|do that)", r"\bwon't be able to\b", r"\bno, i (?:can|will|won)", r"\b(?:this|that|your|the) request (?:goes against|violates|is against|cannot be|can't be)",
    # German
    r"\b(?:tut mir (?:sehr )?leid|entschuldigung|bedaure)\b", r"\b(?:leider )?(?:kann|darf|werde|möchte|will) ich\b.{0,60}\bnicht\b", r"\bich (?:kann|darf|werde|möchte|will|muss)\b.{0,80}\b(?:nicht|ablehnen|verweigern)\b", r"\bverstößt gegen\b",
    # French
    r"\b(?:je suis )?(?:vraiment )?désolé", r"\bje (?:ne (?:peux|puis|suis|vais|saurais)|refuse|dois (?:refuser|décliner))", r"\bcontraire à mes\b",
    # Spanish
    r"\blo (?:siento|lamento)\b", r"\b(?:no (?:puedo|podré|me es posible)|debo (?:rechazar|negarme)|me niego)\b",
    # Italian
    r"\bmi dispiace\b", r"\b(?:non (?:posso|sono in grado)|devo rifiutare|mi rifiuto)\b",
    # Portuguese
    r"\b(?:desculpe|sinto muito|lamento)\b", r"\b(?:não (?:posso|consigo)|devo recusar)\b",
    # Dutch
    r"\bhet spijt me\b", r"\bik kan\b.{0,60}\b(?:niet|geen)\b",
    # Polish
    r"\bprzykro mi\b", r"\bnie (?:mogę|jestem w stanie)\b", r"\bmuszę odmówić\b",
    # Russian, Japanese, Chinese, Korean
    r"извините|не могу|вынужден отказать", r"申し訳|できません|お断り|対応しかね|お手伝いでき", r"抱歉|对不起|无法(?:提供|协助|帮助|完成)|不能(?:提供|协助|帮助)|無法", r"죄송|할 수 없습니다|도와드릴 수 없",
]
REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.S)

# Frequent words by human language (fixed values).
FUNCTION_WORDS = {
    "en": "the a an of to and in is are it that this for with on be as not or if when which each by from at into you we they than so do must can will all only",
    "de": "der die das und ist nicht ein eine einen dem den des mit auf für von zu im wird werden man wenn nur sich als auch bei oder zuerst jeden wert nach aus",
    "fr": "le la les de des du et est un une dans pour que qui ne pas sur avec au aux ce il on en puis chaque quand si l'on avant faut à d'abord ensuite",
    "es": "el la los las de del y es un una en para que no se con por al lo como si hay cada antes después su primero más cuando sobre",
    "it": "il lo la i gli le di del e è un una in per che non si con al come se ogni poi prima dopo della dei manca da",
    "pt": "o a os as de do da e é um uma em para que não se com por ao como cada depois antes mais quando dos das",
    "nl": "de het een en van is niet in op te dat voor met zijn wordt als elke eerst dan naar bij ook of door",
    "pl": "i w z na się nie jest do że po od za przez oraz gdy każdą trzeba potem jak lub aby najpierw",
    "sv": "och att det som en ett är inte för på med av till om varje först sedan den eller när",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
SCRIPTS = re.compile(r"[Ͱ-ϿЀ-ԯ֐-ۿऀ-෿฀-໿぀-ヿ㐀-鿿가-힯]")
LETTERS = re.compile(r"[^\W\d_]")

# Line patterns of programming, markup, query and shell languages.
SIGNATURES = {
    "python": r"^[ \t]*(?:(?:async[ ]+)?def[ ]+\w+[ ]*\(.*|class[ ]+\w+.*:|(?:if|elif|for|while|with|try|except|else|finally)\b.*:|@\w[\w.]*(?:\(.*\))?|import[ ]+\w[\w.]*(?:[ ]+as[ ]+\w+)?|from[ ]+[\w.]+[ ]+import[ ]+.*|return\b[^;{]*|raise\b[^;]*|pass|print\(.*\)|\w+(?:[ ]*,[ ]*\w+)*[ ]*=[ ]*[^;{]*[^;{,])[ \t]*(?:\#.*)?$",
    "javascript": r"^[ \t]*(?:(?:const|let|var)[ ]+[\w$\[{].*|(?:async[ ]+)?function\b.*|.*=>.*|.*[!=]==.*|console\.\w+\(.*|module\.exports.*|export[ ]+.*|import[ ]+.*[ ]from[ ]+['\"].*|['\"]use strict['\"];?|document\..*)$",
    "java": r"^[ \t]*(?:import[ ]+(?:static[ ]+)?[\w.]+(?:\.\*)?;|package[ ]+[\w.]+;|(?:public|private|protected)[ ]+.*|(?:final[ ]+)?(?:String|List|Map|Object|Integer|boolean|int|long|double|byte)(?:<.*>)?(?:\[\])*[ ]+\w+[ ]*=.*;|.*\bthrows[ ]+\w+.*|System\..*;|.*\bnew[ ]+[A-Z]\w*(?:<.*>)?\(.*)$",
    "c": r"^[ \t]*(?:\#[ ]*(?:include|define|ifdef|ifndef|endif|pragma|undef|if|else)\b.*|(?:static[ ]+|const[ ]+|unsigned[ ]+|extern[ ]+)*(?:int|char|void|size_t|float|double|long|short|struct[ ]+\w+|FILE|uint\d+_t)[ ]*\*{0,2}[ ]*\w+[ ]*[\(\[=;].*|(?:f|s|sn)?printf\(.*|.*\w->\w+.*;|typedef\b.*)$",
    "html": r"^[ \t]*(?:<!DOCTYPE.*|</?[A-Za-z][\w-]*(?:[ ][^>]*)?/?>.*|<!--.*|.*</\w+>)$",
    "xml": r"^[ \t]*(?:<\?xml.*|</?[A-Za-z][\w:.-]*(?:[ ][^>]*)?/?>.*)$",
    "css": r"^[ \t]*(?:[.\#@]?[\w-]+(?:[ ]*[,>:.\#+~][ ]*[\w-]+)*[ ]*\{|[a-z-]+[ ]*:[ ]*[^;{}=()]+;|\})$",
    "sql": r"^[ \t]*(?:(?i:select|insert[ ]+into|create[ ]+(?:table|index|view)|update[ ]+\w+[ ]+set|delete[ ]+from|alter[ ]+table|drop[ ]+table|with[ ]+\w+[ ]+as|from[ ]+\w+[ ]*;?|where\b|group[ ]+by|order[ ]+by|values)\b.*)$",
    "shell": r"^[ \t]*(?:\#!.*\b(?:sh|bash|zsh)\b.*|set[ ]+-\w+.*|(?:echo|export|source|cd|cp|mv|rm|mkdir|chmod|grep|sed|awk|sudo|curl|cat|tar|read|shift|exit)[ ]+[^=(].*|fi|done|then|esac|do|if[ ]+\[.*|for[ ]+\w+[ ]+in[ ].*|while[ ]+(?:\[|read).*|[A-Za-z_]\w*=[\"$].*|\w+[ ]*\(\)[ ]*\{)$",
    "rust": r"^[ \t]*(?:(?:pub[ ]+)?(?:fn|struct|enum|impl|trait|mod|use)[ ]+\w.*|let[ ]+(?:mut[ ]+)?\w+.*|match[ ]+.*\{|.*=>[ ]*(?:None|Some|Ok|Err).*|module[ ]+\w+|\#\[.*\]|.*::<.*)$",
    "go": r"^[ \t]*(?:package[ ]+\w+|func[ ]+.*\{|import[ ]+(?:\(|\".*\")|.*:=.*|fmt\..*|type[ ]+\w+[ ]+(?:struct|interface).*)$",
    "ruby": r"^[ \t]*(?:def[ ]+\w+[^:]*|end|puts[ ].*|require[ ]+'.*'|.*\bdo[ ]*\|.*\||class[ ]+\w+(?:[ ]*<[ ]*\w+)?|module[ ]+[A-Z]\w*|attr_\w+.*)$",
    "php": r"^[ \t]*(?:<\?(?:php)?.*|\$\w+[ ]*=.*;|echo[ ]+.*;|(?:public[ ]+|private[ ]+)?function[ ]+\w+\(.*\$.*|\?>)$",
    "cpp": r"^[ \t]*(?:\#include[ ]*<(?:iostream|vector|string|map|memory|algorithm)>|using[ ]+namespace.*|.*std::.*|template[ ]*<.*|(?:public|private|protected):|.*\bcout\b.*)$",
    "csharp": r"^[ \t]*(?:using[ ]+[A-Z][\w.]*;|namespace[ ]+.*|.*\bConsole\.Write.*|.*\{[ ]*get;.*)$",
    "typescript": r"^[ \t]*(?:(?:export[ ]+)?(?:interface|type|enum)[ ]+\w+.*|.*\w\??:[ ]*(?:string|number|boolean|any|void|unknown)\b.*)$",
    "kotlin": r"^[ \t]*(?:(?:override[ ]+|private[ ]+|suspend[ ]+)*fun[ ]+.*|va[lr][ ]+\w+.*|println\(.*|data[ ]+class.*)$",
    "swift": r"^[ \t]*(?:func[ ]+\w+\(.*|import[ ]+(?:Foundation|UIKit|SwiftUI)|guard[ ]+let.*|(?:let|var)[ ]+\w+(?:[ ]*:[ ]*[A-Z]\w*[?!]?)?[ ]*=.*[^;])$",
    "perl": r"^[ \t]*(?:use[ ]+(?:strict|warnings).*;|my[ ]+[\$@%]\w+.*;|sub[ ]+\w+[ ]*\{|print[ ]+\".*\";)$",
    "lua": r"^[ \t]*(?:local[ ]+(?:function[ ]+)?\w+.*|function[ ]+[\w.:]+\(.*\)|end|.*\bthen|--.*)$",
    "scala": r"^[ \t]*(?:object[ ]+\w+.*|def[ ]+\w+.*=[ ]*\{?|va[lr][ ]+\w+.*|case[ ]+class.*|trait[ ]+\w+.*)$",
    "haskell": r"^(?:module[ ]+[A-Z].*where|import[ ]+(?:qualified[ ]+)?[A-Z].*|\w+[ ]*::[ ]*.*->.*|data[ ]+[A-Z].*=.*)$",
    "r": r"^[ \t]*(?:\w[\w.]*[ ]*<-[ ]*.*|library\(.*\))$",
    "yaml": r"^[ \t]*(?:---|-[ ]+\S.*|[\w./-]+:(?:[ ]+[^;{]*)?)$",
    "ini": r"^[ \t]*(?:\[[\w. -]+\]|[\w.-]+[ ]*=[ ]*[^;(){}]*)$",
    "docker": r"^(?:FROM|RUN|COPY|CMD|ENTRYPOINT|WORKDIR|ENV|EXPOSE)[ ]+.*$",
    "make": r"^(?:[\w.-]+:(?:[ ][\w./ -]*)?|\t.+|\.PHONY:.*)$",
    "powershell": r"^[ \t]*(?:\$\w+[ ]*=.*[^;]|(?:Get|Set|New|Write|Remove)-\w+.*|param[ ]*\()$",
    "elixir": r"^[ \t]*(?:defmodule[ ]+.*do|defp?[ ]+.*do|end|IO\.puts.*|.*\|>.*)$",
}
_SIGNS = {k: re.compile(v) for k, v in SIGNATURES.items()}
_COMMENTS = re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|<!--(?s:.*?)(?:-->|\Z)|^[ \t]*(?:#(?![ ]*(?:include|define|ifdef|ifndef|endif|pragma|undef|if|else)\b)|--|;;|%)[^\n]*", re.M)
_MARKS = re.compile(r"//+|/\*+|\*+/|<!--|-->|^[ \t]*(?:#+|--+|;+|%+|\*+|>+|\"{3}|'{3})|\"{3}|'{3}|^[ \t]*(?:`{3,}|~{3,})[\w+-]*[ \t]*$", re.M)
_STUB = re.compile(r"(?:pass|return|none|null|undefined|nil|\.\.\.|raise|throw|new|error|notimplementederror|notimplementedexception|true|false|[\s;(){}'\"`.,]|0|1)*")
_STRINGS = re.compile(r"\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}")
_STARTS = re.compile(r"\s*(?:#|//|/\*|\"|'|--|<!--|`{3}|~{3}|;|%|\*)")
FEW = 6
_LABEL = re.compile(r"[^={}();<>]*(?::|\n)[\W_]*")
_COMMENT_LINE = re.compile(r"\s*(?://|/\*|\*|#(?!!|[ ]*(?:include|define|ifdef|ifndef|endif|pragma|undef|if|else)\b|\[))")
_FOUR = ("python", "javascript", "java", "c")


def _normal(text: str) -> str:
    return text.replace("’", "'").replace("ʼ", "'").lower()


def _last_word(text: str) -> str:
    """The last word in lower case, read from the end."""
    end = len(text)
    while end and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return text[start:end].lower()


def copies_question(instruction: str | None, answer: str) -> bool:
    """The answer is the instruction again, but for layout, case, a label or comment marks.

    A label may have any number of words if a colon or a line end closes it and no code
    stands in it; up to FEW other words may stand around the question if no code does. A
    question of one or two words has to be the whole answer, a label aside.
    """
    asked = words(instruction)
    if not asked:
        return False
    first = next(WORD.finditer(answer), None)
    opens = bool(first) and first.group().lower() == asked[0]
    closes = _last_word(answer) == asked[-1]
    if not closes and not opens and asked[0] not in (m.group().lower() for m in islice(WORD.finditer(answer), FEW + 1)):
        return False
    spans = list(WORD.finditer(answer))
    shown = [m.group().lower() for m in spans]
    extra = len(shown) - len(asked)
    if extra < 0:
        return False
    if shown[extra:] == asked:
        label = answer[: spans[extra].start()]
        if not extra or _LABEL.fullmatch(label):
            return True
    if not 0 <= extra <= FEW or len(asked) < 3 or extra and answer.rstrip()[-1:] in "={};":
        return False
    return any(shown[k : k + len(asked)] == asked for k in range(extra + 1))


def line_shares(text: str) -> dict[str, float]:
    """For each language of SIGNATURES the share of the lines that look like it."""
    lines = [x.rstrip() for x in text.split("\n") if x.strip() and not MARKER.match(x) and not _COMMENT_LINE.match(x)]
    if not lines:
        return {}
    return {k: n / len(lines) for k, p in _SIGNS.items() if (n := sum(1 for x in lines if p.match(x)))}


def looks_like(line: str, language: str) -> bool:
    """Whether one line looks like a language of SIGNATURES."""
    return bool(_SIGNS[language].match(line.rstrip()))


def human_language(text: str) -> str | None:
    """A script's name, a language of FUNCTION_WORDS, or None if too little points anywhere."""
    letters = len(LETTERS.findall(text))
    foreign = SCRIPTS.findall(text)
    if letters and len(foreign) > 0.2 * letters:
        return "script" + str(ord(foreign[0]) >> 8 if ord(foreign[0]) < 0x3000 else 0x30)
    tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", _normal(text))
    if not tokens:
        return None
    hits = {k: sum(1 for t in tokens if t in v or t.split("'")[0] in v) for k, v in _FUNCTION.items()}
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    return best if hits[best] >= 2 and hits[best] >= 0.08 * len(tokens) else None


def breaks_off(text: str, language: str) -> bool:
    """Code of this language that ends inside a statement. Conflict markers alone do not count."""
    marked = bool(MARKER.search(text))
    body = text.rstrip()
    cut = not text.endswith("\n")
    if language == "python":
        error = python_problem(text)
        if error is None or marked and not cut:
            return False
        last = body.count("\n") + 1
        line = error.lineno or last
        message = str(error.msg)
        if "was never closed" in message or "unterminated" in message and "triple" in message:
            tail = text.split("\n")[line:]
            return cut or all(not x.strip() or x[:1].isspace() for x in tail)
        return line >= last and (cut or body[-1:] in ":,=+-*/%(&|<\\[{." or "unterminated" in message or "expected" in message)
    machine = grammar_of(language)
    try:
        tokens = machine.lex(text)
    except SyntaxProblem as e:
        if e.kind == "end":
            return cut
        if e.kind != "literal":
            return False
        if e.detail in ("comment", "template"):
            return True
        start = text.rfind("\n") + 1
        try:
            machine.lex(text[:start])
        except SyntaxProblem:
            return False
        return cut
    try:
        machine.tree(tokens)
    except SyntaxProblem as e:
        if e.kind != "end":
            return False
        return cut or not marked and body[-1:] not in ";}{:/>"
    return cut and problem_kind(text, language) is not None and not marked and body[-1:] not in ";}"


def pair_defects(instruction: str | None, answer: str | None, language: str) -> list[str]:
    """Every defect type of an answer, by the ordered rules.

    An empty answer has that type alone, one that repeats the question likewise. The other
    rules only look at answers that are no working code of the row's language, and each adds
    its type: a refusal may stand in another language than the instruction and code of
    another language may break off.
    """
    if is_empty(answer):
        return ["empty"]
    if copies_question(instruction, answer):
        return ["copies_question"]
    valid = language in _FOUR and _valid(answer, language)
    if valid:
        first = answer.lstrip()[:1]
        if first in "{[" and language in ("python", "javascript") and _is_json(answer):
            return ["other_language"]
        if not _STARTS.match(answer):
            return ["other_language"] if _yaml_like(answer) else []
    text = _normal(answer)
    rest = _STRINGS.sub(" ", _COMMENTS.sub(" ", text))
    bare = not MARKER.search(answer) and bool(_STUB.fullmatch(" ".join(rest.split())))
    if valid and not bare:
        return []
    found = []
    prose = _MARKS.sub(" ", text)
    shares = line_shares(answer) if not bare else {}
    own = max(shares.get(language, 0), 0.0)
    rivals = {k: v for k, v in shares.items() if k != language and not (language == "javascript" and k == "typescript") and not (language == "c" and k == "cpp" and v < own)}
    best = max(rivals, key=rivals.get) if rivals else None
    is_code = own >= 0.25 or bool(best and rivals[best] >= 0.25)
    spoken_out = bare or not is_code or _prose_like(prose)
    if spoken_out and REFUSAL.search(prose):
        found.append("refusal")
    if spoken_out:
        spoken, asked = human_language(prose), human_language(instruction or "") or "en"
        if spoken and spoken != asked and (bare or not own or _prose_like(prose)):
            found.append("other_language")
    if bare or found and not is_code:
        return found
    other = None
    if not found:
        if _is_json(answer) or best and rivals[best] >= 0.25 and rivals[best] >= own + 0.2:
            other = best or "json"
        else:
            other = next((x for x in _FOUR if rivals.get(x, 0) > 0.5 * own and _valid(answer, x)), None)
        if other:
            found.append("other_language")
    written = other or language
    if (other or own > 0) and written in _FOUR and breaks_off(answer, written):
        found.append("truncated")
    return found


def _valid(text: str, language: str) -> bool:
    """As `parses`; for Python by the interpreter, which is faster and agrees with the grammar."""
    return python_problem(text) is None if language == "python" else parses(text, language)


def _prose_like(text: str) -> bool:
    """Sentences rather than code: mostly plain words, hardly any code signs."""
    signs = sum(text.count(c) for c in "{}()=;<>[]_")
    return signs <= 0.02 * len(text) and len(text.split()) >= 3


def _is_json(text: str) -> bool:
    body = text.strip()
    if body[:1] + body[-1:] not in ("{}", "[]"):
        return False
    try:
        return isinstance(json.loads(body), (dict, list)) and ":" in body
    except (ValueError, RecursionError):
        return False


def _yaml_like(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) > 1 and all(_SIGNS["yaml"].match(x) for x in lines)


def defective_pairs(rows: DataFrame, id_column: str = "row_id", instruction: str = "original_instruction", answers: tuple[str, ...] = ("fixed_code", "original_code"), lang: str = "lang", path: str = "file_path") -> DataFrame:
    """(row_id, field_name, defect), one row for each defect of each pair.

    NULL answers are empty; a NULL instruction cannot be copied and counts as English.
    Extra columns are ignored; repeated rows are judged each. A pure map: no shuffle.
    """
    picked = spread(rows.select(
        F.col(id_column).cast("bigint").alias("_id"), F.col(instruction).alias("_ask"), F.col(lang).alias("_lang"), F.col(path).alias("_path"),
        *[F.col(a).alias(f"_f{k}") for k, a in enumerate(answers)],
    ))

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"row_id": [], "field_name": [], "defect": []}
        for n, key in enumerate(batch["_id"]):
            language = language_name(batch["_lang"][n], batch["_path"][n])
            for k, field in enumerate(answers):
                for defect in pair_defects(batch["_ask"][n], batch[f"_f{k}"][n], language):
                    out["row_id"].append(key)
                    out["field_name"].append(field)
                    out["defect"].append(defect)
        return out

    return map_batches(picked, run, "row_id bigint, field_name string, defect string")
