"""Problem 9: template residue, filler, error pages and notices in place of real content.

Detectors find unfilled slots and candidates: sentences with the wording of filler, error
pages and notices, and sentences of machine terms. A slot decides alone. A candidate is
compared with the address slug, the title and the other sentences of the body: real speech
shares terms with them, a page does not. What is strange there counts if it makes up its
sentence by itself, or if the same sentence, numbers aside, stands strange under several
unrelated addresses. A sentence of which that is known is also found inside other sentences.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.values import map_batches, words
from quillsift.session import cut_lineage, spread

#: Unrelated addresses under which a candidate has to occur.
HOSTS = 3
#: Share of a sentence's terms, those of machines and markup included, from which the wording makes it up by itself.
COVERED = 0.5
#: Words that may stand before the wording of a page ("Oops!", "Error 500 -").
LEAD = 2

# Names of slots (fixed values, matched in lower case, blanks for underscores).
_NAME_PHRASES = frozenset(
    "brand|brand name|product|product name|name|first name|last name|full name|user name|username|customer|customer name|customer first name|company|company name|store|store name|shop name|item name|item title|order id|order number|"
    "order date|rating|rating text|review text|review body|review title|your text here|your text|your name|your name here|your review here|text here|insert text here|placeholder|product description|tracking number|city|country|price|amount".split("|")
)
_HTML = frozenset("a abbr address article b blockquote body br button caption code dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s section select small span strike strong sub sup table tbody td tfoot th thead time title tr tt u ul var video".split())
_FIRM = [
    re.compile(r"\{\{\{?\s*([^{}\n]+?)\s*\}\}\}?"), re.compile(r"\[\[\s*([^\[\]\n]+?)\s*\]\]"), re.compile(r"[$#]\{\s*([^{}\n]+?)\s*\}"),
    re.compile(r"<%=?\s*([^%\n]+?)\s*%>"), re.compile(r"@@\s*([^@\n]+?)\s*@@"), re.compile(r"\{%\s*([^%\n]+?)\s*%\}"),
]
_SOFT = [re.compile(r"\[\s*([^\[\]\n]+?)\s*\]"), re.compile(r"<\s*([^<>\n/=\"]+?)\s*>"), re.compile(r"\{\s*([^{}\n]+?)\s*\}"), re.compile(r"%([A-Za-z][\w. -]+?)%"), re.compile(r"(?<!\w)__([A-Za-z][\w. -]+?)__(?!\w)"), re.compile(r"(?<!\w)X{4,}(?!\w)()")]
_IDENT = re.compile(r"[A-Za-z]\w*(?:[._-]\w+)+|[a-z]+[A-Z]\w*")
_WORDY = re.compile(r"[^\W\d_][\w .'-]*(?:\s*\|\s*[\w .:'\"()-]+)?")

# Wording of pages, filler and notices; what matches is a candidate (fixed values, matched in lower case).
CLEAR = [
    # filler
    r"\blorem ipsum dolor\b", r"\bipsum dolor sit amet\b", r"\bconsectetur adipiscing elit\b", r"\bdolor sit amet\b", r"\bsed do eiusmod tempor\b", r"\but (?:enim ad minim|labore et dolore)\b", r"\bquis nostrud exercitation\b", r"\bduis aute irure\b", r"\bin reprehenderit in voluptate\b", r"\bexcepteur sint occaecat\b", r"\bcupidatat non proident\b", r"\bmollit anim id est\b", r"\bthis is (?:a )?(?:sample|dummy|placeholder|filler|test|example) (?:text|review|content)\b", r"\b(?:placeholder|dummy|sample|filler) text (?:for|goes here|here)\b", r"\btodo\s*:?\s*(?:add|write|insert|fill|replace)\b",
    r"\bfixme\s*:", r"\b(?:write|enter|type|insert|add|put) (?:your|the|a) (?:own )?(?:review|text|comment|opinion|title|description|message|content) here\b", r"\b(?:your|review|insert) (?:text|review|content|title|name) (?:goes )?here\b", r"\breplace (?:it|this(?: text)?) with your (?:own )?(?:review|text|content)\b",
    r"\bblindtext\b.{0,30}\bersetzen\b", r"\b(?:dies|das) ist ein (?:blind|platzhalter|muster|beispiel)text\b", r"\bplatzhaltertext\b", r"\bhier (?:ihren?|deinen?|den) (?:text|bewertung|kommentar|titel) (?:eingeben|einfügen|schreiben)\b", r"\bihre? (?:text|bewertung) hier\b", r"\b(?:votre|saisissez votre|écrivez votre|insérez votre) (?:avis|texte|commentaire|titre) ici\b",
    r"\bceci est un (?:faux )?texte (?:d'exemple|de remplissage|factice)\b", r"\btexte (?:d'exemple|de remplissage)\b", r"\b(?:escriba|escribe|introduzca|introduce|inserte|ingrese) (?:aquí )?(?:su|tu) (?:opinión|texto|comentario|reseña|título)(?: aquí)?\b", r"\bescrib[ae] aquí\b", r"\bsu (?:texto|opinión) aquí\b", r"\b(?:este|esto) es un texto de (?:ejemplo|prueba|relleno)\b",
    r"\bno (?:content|text|description) (?:provided|available|here)\b", r"\bcontent goes here\b",
    # error pages
    r"\bthe requested (?:url|page|resource|document)\b.{0,200}\b(?:was|could|is|does|has)\b.{0,20}\b(?:not (?:found|be found|exist|available)|moved)\b", r"\b(?:error )?[45]\d\d\s*(?:[-–:]\s*)?(?:internal server error|bad gateway|gateway time-?out|too many requests)\b", r"(?:^|[\n>])\s*(?:(?:http )?(?:error )?(?:40\d|410|429|50\d|520)\b[\s:–-]*(?:not found|page not found|forbidden|unauthorized|service unavailable|bad request|gone|error)|http/1\.\d [45]\d\d)",
    r"<h\d>\s*[45]\d\d\b", r"\bbad gateway\s*\n?\s*(?:nginx|apache|cloudflare)\b", r"\binternal server error\b.{0,40}\b(?:try again|ref|contact|reload)", r"\bservice (?:is )?temporarily unavailable\b.{0,40}(?:request|ref|try|id|\d)", r"\b(?:access|permission) denied\b.{0,20}\b(?:you|your)\b", r"\byou (?:don't|do not) have permission to (?:access|view)\b",
    r"\bdatabase (?:connection|error|query)\b.{0,20}\b(?:failed|error|refused|timed out)\b", r"\berror establishing a database connection\b", r"\btraceback \(most recent call last\)\s*:", r"\bnull ?pointer\b.{0,10}\b(?:while|exception|at)\b", r"\b(?:uncaught |unhandled )(?:exception|typeerror|error)\b", r"\bjava\.lang\.\w+", r"\b(?:key|type|value|attribute|reference|runtime)error: ", r"\bfatal error\s*:", r"\bstack trace\s*:",
    r"\bwarning: (?:undefined|mysql|include)\w*", r"\bsegmentation fault\b", r"\bsomething went wrong (?:while|when|on our|loading|processing)", r"\ban (?:unexpected |internal )?error (?:has )?occurred (?:while|during|processing|on the server)", r"\b(?:we're|we are) sorry,? (?:but )?(?:something|an error|the page|this page)", r"\bthis (?:page|site|content|review) (?:isn't|is not|is no longer|can't be|cannot be|could not be) (?:available|reached|loaded|displayed)\b",
    r"\bseite nicht gefunden\b", r"\bdie (?:angeforderte )?seite (?:wurde nicht gefunden|existiert nicht)\b", r"\binterner serverfehler\b", r"\bzugriff verweigert\b", r"\bpágina no encontrada\b", r"\berror interno del servidor\b", r"\bacceso denegado\b", r"\bpage (?:introuvable|non trouvée)\b", r"\berreur interne du serveur\b", r"\baccès (?:refusé|interdit)\b", r"\bservice (?:temporairement )?indisponible\b", r"\bpage not found\b(?=\s*(?:$|[\n|.–-]))",
    r"\btoo many requests\b", r"\brequest (?:id|blocked|timed out)\b.{0,4}[:#\d]", r"\bray id\b", r"\bunder maintenance\b.{0,40}\b(?:back|try|check)\b",
    # notices about scripts, browsers, cookies, access
    r"\b(?:please|you (?:need|have|must) to|you must|kindly)\s+(?:enable|activate|turn on|allow) (?:javascript|cookies|js)\b", r"\bjavascript (?:is|must be|has to be|needs to be) (?:required|disabled|enabled|turned off|not enabled|not available|deactivated)\b", r"\b(?:this|your) browser (?:is|does) not support(?:ed)?\b", r"\bchecking your browser before\b", r"\bverify(?:ing)? (?:that )?you are (?:a )?human\b", r"\b(?:complete|solve) the captcha\b", r"\bi'm not a robot\b",
    r"\bbitte (?:aktivieren|erlauben|schalten) sie (?:javascript|cookies)\b", r"\bjavascript (?:ist|muss) (?:deaktiviert|aktiviert|erforderlich)", r"\b(?:veuillez|merci d'|vous devez) ?(?:activer|autoriser) (?:javascript|les cookies)\b", r"\b(?:por favor,? )?(?:active|activa|habilite|habilita|debe activar) (?:javascript|las cookies|el javascript)\b",
    r"\b(?:debe|debes|tiene que|tienes que|necesita|necesitas|es necesario) (?:habilitar|activar|tener activado) (?:el )?(?:javascript|las cookies)\b", r"\b(?:abilita|attiva|abilitare|attivare|devi abilitare|è necessario abilitare) javascript\b", r"\b(?:ative|habilite|ativar|é necessário ativar) o? ?javascript\b", r"\b(?:schakel javascript in|javascript inschakelen)\b", r"\b(?:włącz|proszę włączyć) javascript\b",
    r"\b(?:sie müssen|du musst) javascript (?:aktivieren|einschalten)\b", r"\bil faut activer (?:javascript|les cookies)\b", r"\bjavascript (?:doit être|est) (?:activé|désactivé|requis)", r"\bjavascript (?:está|debe estar) (?:desactivado|activado|habilitado|deshabilitado)", r"\bturn javascript on\b",
    r"\bwe (?:and our partners )?(?:use|value)\b.{0,20}\b(?:cookies|privacy)\b", r"\bthis (?:site|website|page|shop) uses cookies\b", r"\baccept (?:all )?(?:cookies|all)\b.{0,20}\bto continue\b", r"\bwir verwenden cookies\b", r"\bdiese (?:web)?seite (?:verwendet|nutzt) cookies\b", r"\b(?:nous utilisons|ce site utilise) des cookies\b", r"\b(?:usamos|utilizamos|este sitio (?:web )?(?:usa|utiliza)) cookies\b",
    r"\byour session (?:has )?(?:expired|timed out|ended)\b", r"\b(?:ihre|deine) sitzung ist abgelaufen\b", r"\bvotre session a expiré\b", r"\bsu sesión ha (?:expirado|caducado)\b", r"\b(?:sign|log) in to (?:continue|view|read|see)\b", r"\b(?:subscribe|register|sign up) to (?:continue|read|unlock)\b", r"\bturn off your ad ?blocker\b", r"\byou are being redirected\b", r"\bclick here if you are not redirected\b",
]
# Filler that people also say; it has to be a sentence by itself (fixed values).
SOFT = [r"\btest test test\b", r"\basdf(?:\s*asdf|ghjkl?|jkl)\b", r"\basdf asdf\b", r"\bblah blah blah\b", r"\bfoo bar baz\b", r"\bqwerty qwerty\b"]
_CLEAR = re.compile("|".join(f"(?:{p})" for p in CLEAR), re.S)
_SOFT_WORDS = re.compile("|".join(f"(?:{p})" for p in SOFT), re.S)
# Every wording above holds one of these words (or a heading tag); texts without any skip the search (fixed values).
KEYS = frozenset(
    "ipsum adipiscing amet eiusmod veniam minim labore nostrud irure reprehenderit excepteur cupidatat mollit sample dummy placeholder filler test example todo fixme here blindtext platzhaltertext mustertext beispieltext hier ici aquí factice remplissage exemple escriba escribe introduzca introduce inserte ingrese "
    "relleno prueba ejemplo replace asdf asdfasdf asdfghjk asdfghjkl asdfjkl blah bar qwerty provided available requested error internal gateway nginx apache cloudflare requests found forbidden unauthorized unavailable gone http denied permission "
    "database traceback null nullpointer exception typeerror java keyerror valueerror attributeerror referenceerror runtimeerror fatal stack segmentation warning wrong sorry isn reached loaded displayed longer gefunden existiert serverfehler "
    "verweigert encontrada interno denegado introuvable trouvée erreur refusé interdit indisponible request ray maintenance javascript cookies js browser human captcha robot privacy accept session sitzung sesión sign log subscribe register "
    "blocker adblocker redirected "
    # run together with the next or the previous word
    "todoadd todowrite todoinsert todofill todoreplace gatewaynginx gatewayapache gatewaycloudflare".split()
) | {f"{code}gateway" for code in range(400, 600)}

# Wording a writer may use too; a whole sentence of it needs the evidence (fixed values).
DOUBTFUL = re.compile(
    r"(?:please |bitte |veuillez |por favor,? )?(?:try again(?: later| in \d+ \w+)?|sign in(?: again)?|log in(?: again)?|reload(?: the page)?|refresh(?: the page)?|oops|loading|not found|forbidden|unauthorized|access denied|service unavailable|no results|coming soon|n/?a|test|untitled|null|undefined|nan|versuchen sie es später(?: erneut)?|réessayez plus tard|inténtelo más tarde|javascript is required|error \d+|código \d+|ref \d+|read more|show more|review|text|title)[.!…]*"
)
# Terms of machines and access; a sentence with MACHINE_TERMS of them in which nobody says I needs the evidence too (fixed values).
MACHINE_TERMS = 3
MACHINE = frozenset(
    "server servers request requests error errors page website site url http https browser network traffic connection session access administrator database gateway proxy timeout cookies javascript login account password captcha robot automated ip firewall blocked denied temporary temporarily unavailable maintenance expired computer system systems service detected unusual encountered "
    "seite webseite fehler anfrage anfragen zugriff netzwerk verbindung sitzung konto browser datenverkehr administrator wartung gesperrt página sitio servidor solicitud solicitudes conexión sesión cuenta acceso navegador tráfico red mantenimiento bloqueado administrador serveur requête requêtes connexion compte accès navigateur trafic réseau erreur système sistema bloqué administrateur".split()
)
# Who speaks or is spoken of in a review (pages say we), and how a review reports what a page or a sign says (fixed values).
_SPEAKERS = frozenset(
    "i me my mine myself he she his her they ich mich mir mein meine meinem meinen meiner er je j me m moi mon ma mes elle yo mi mis mí él ella".split()
)
_REPORTED = re.compile(
    r"(?:\b(?:say|says|said|saying|read|reads|show|shows|showed|showing|display|displays|displayed|print|prints|printed|saw|see|sees|message|messages|called|named|labelled|sagt|sagte|zeigt|zeigte|meldet|meldete|meldung|steht|stand|dice|decía|muestra|mostró|mensaje|dit|disait|affiche|affichait)\b[\W_]*(?:(?:a|an|the|only|just|me|us|that|of|ein|eine|einen|die|der|das|un|una|une|le|la|el)\b\W*){0,2}|[\"“„«‘]\s*)$"
)
# Words without content (fixed values).
_LIGHT = frozenset(
    "a an the and or but of in on at to for with by from is are was were be been it its this that these those you your not no as has have had do does did so if than then too very can will would please "
    "der die das den dem ein eine einen und oder aber mit von zu im in ist sind war es nicht sie ihr ihre bitte um für auf el la los las un una y o de en con por para es son no su se que lo este esta debe le les des du et ou est sont ne pas ce cette vous votre pour sur dans".split()
)
_SENTENCE = re.compile(r"[^.!?\n…]+[.!?…]*")


class Finding(NamedTuple):
    """What one place of a text shows: `decided` needs no evidence, `alone` is a sentence by
    itself, `key` names the wording, `segment` the sentence with numbers masked, `strange`
    whether it shares no terms, `known` the terms around it."""

    decided: bool
    alone: bool
    key: str
    segment: str
    strange: bool
    known: list[str]


def unfilled_slots(text: str) -> list[str]:
    """The unfilled template slots of a text. Doubtful brackets count only around a slot's name."""
    found = []
    if "{" in text or "[" in text or "<" in text or "%" in text or "@@" in text or "__" in text or "XXXX" in text:
        for p in _FIRM:
            for m in p.finditer(text):
                body = m.group(1)
                if _IDENT.match(body) or _WORDY.fullmatch(body):
                    found.append(m.group())
        for p in _SOFT:
            for m in p.finditer(text):
                body = m.group(1)
                if not body:
                    found.append(m.group())
                    continue
                plain = re.sub(r"[\s_.-]+", " ", body).strip().lower()
                if p.pattern.startswith("<") and plain.split(" ")[0] in _HTML and plain not in _NAME_PHRASES - _HTML:
                    continue
                if plain in _NAME_PHRASES or _IDENT.fullmatch(body) and not body.isdigit() or re.fullmatch(r"(?:insert|enter|add|your|type)(?: [\w']+){1,4}|[\w ]+ (?:here|goes here)", plain) or re.fullmatch(r"(?:[a-z]+ )?(?:name|id|title|date|number|text|body)", plain) and " " in plain:
                    found.append(m.group())
    return found


def masked(text: str) -> str:
    """One line with numbers masked and no sign at its end."""
    return re.sub(r"\d+", "0", " ".join(text.split())).strip(" .!?…")


def content(text: str) -> set[str]:
    """The words that say something."""
    return {w for w in words(text) if w not in _LIGHT and not w.isdigit()}


def strange(terms: set[str], known: set[str]) -> bool:
    """Whether a sentence shares no more than a third of its terms with what surrounds it."""
    return 3 * len(terms & known) <= len(terms)


def _machine_like(sentence: str) -> bool:
    said = set(words(sentence))
    return len(said & MACHINE) >= MACHINE_TERMS and not said & _SPEAKERS


def findings(text: str | None, title: str | None = None, slug: str | None = None) -> list[Finding]:
    """Slots and candidates of one text. NULL and empty texts have none.

    The terms around a candidate are those of slug, title and the sentences that are no candidates.
    """
    if not text:
        return []
    if unfilled_slots(text):
        return [Finding(True, True, "slot", "", True, [])]
    plain = text.lower().replace("’", "'")
    sentences = [(m.start(), m.end()) for m in _SENTENCE.finditer(plain) if m.group().strip()]
    hits: dict[int, list[tuple[int, int, bool]]] = {}
    if not KEYS.isdisjoint(words(plain)) or "<h" in plain:
        spans = [(m.start(), m.end(), False) for m in _CLEAR.finditer(plain)] + [(m.start(), m.end(), True) for m in _SOFT_WORDS.finditer(plain)]
        at = 0
        for start, end, soft in sorted(spans):
            while at < len(sentences) - 1 and sentences[at][1] <= start:
                at += 1
            hits.setdefault(at, []).append((start, end, soft))
    doubtful = {k for k, (a, b) in enumerate(sentences) if k not in hits and (DOUBTFUL.fullmatch(s := plain[a:b].strip()) or _machine_like(s))}
    if not hits and not doubtful:
        return []
    around = content(title or "") | content((slug or "").replace("-", " ").replace("_", " "))
    covered: set[int] = set()
    for k, found in hits.items():
        last = max(end for _, end, _ in found)
        covered |= {n for n in range(k, len(sentences)) if sentences[n][0] < last}
    for k, (a, b) in enumerate(sentences):
        if k not in covered and k not in doubtful:
            around |= content(plain[a:b])
    out = []
    for k in sorted(doubtful):
        segment = masked(plain[slice(*sentences[k])])
        out.append(Finding(False, True, "doubt", segment, not content(segment) & around, []))
    for k, found in hits.items():
        begin, first = sentences[k][0], found[0][0]
        stop = max(max(end for _, end, _ in found), sentences[k][1])
        whole, lead = plain[begin:stop], plain[begin:first]
        segment, key = masked(whole), " ".join(masked(plain[found[0][0] : found[0][1]]).split()[:2])
        terms = content(whole)
        told = set().union(*(words(plain[a:b]) for a, b, _ in found))
        share = len(terms & (told | MACHINE | _HTML)) / max(1, len(terms))
        soft = all(x for *_, x in found)
        if _REPORTED.search(lead):
            continue
        by_itself = len(words(lead)) <= LEAD and (share > 0.8 if soft else not set(words(whole)) & _SPEAKERS or share >= 0.8)
        if by_itself:
            odd = strange(terms, around)
            out.append(Finding(odd and share >= COVERED, True, key, segment, odd, []))
        if not by_itself or share < COVERED:
            out.append(Finding(False, False, key, segment, True, sorted(around)))
    return out


def residue(docs: DataFrame, hosts: int = HOSTS) -> DataFrame:
    """(doc_id, reason) for every document that is or holds residue, each row of `docs` once.

    `docs` has doc_id, text, title and item_key (the address slug); NULL titles and slugs
    share no term with anything. Repeated documents are judged each, an empty table gives
    none. Texts are looked through once; the findings, a small part, are written down,
    counted by sentence and address, and only they are shuffled.
    """
    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("row", "doc_id", "slug", *Finding._fields)}
        for row, key, text, title, slug in zip(batch["row"], batch["doc_id"], batch["text"], batch["title"], batch["item_key"]):
            for found in dict.fromkeys(f._replace(known=tuple(f.known)) for f in findings(text, title, slug)):
                out["row"].append(row)
                out["doc_id"].append(key)
                out["slug"].append(slug)
                for name, value in zip(Finding._fields, found):
                    out[name].append(list(value) if name == "known" else value)
        return out

    scan = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "title", F.col("item_key").cast("string").alias("item_key")))
    ddl = "row bigint, doc_id bigint, slug string, decided boolean, alone boolean, key string, segment string, strange boolean, known array<string>"
    looked = cut_lineage(map_batches(scan.withColumn("row", F.monotonically_increasing_id()), run, ddl).where("strange"))
    shared = looked.where("alone and key <> 'slot'").select("key", "segment", "slug").distinct().groupBy("key", "segment").agg(F.count("slug").alias("hosts")).where(F.col("hosts") >= hosts)
    shared = cut_lineage(shared.select(F.col("key").alias("_key"), F.col("segment").alias("_segment")))
    found = lambda rows, reason: rows.select("row", "doc_id", F.lit(reason).alias("reason"))
    again = looked.where("alone and not decided").join(shared, (F.col("key") == F.col("_key")) & (F.col("segment") == F.col("_segment")), "left_semi")
    split = lambda c: F.array_except(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "), " "), F.array(*[F.lit(w) for w in ("", "0", *sorted(_LIGHT))]))
    terms, rest = split(F.col("_segment")), split(F.replace(F.col("segment"), F.col("_segment"), F.lit(" ")))
    outside = F.array_union(F.col("known"), rest)
    # Two words may be said by chance; a page says more.
    held = F.col("segment").contains(F.col("_segment")) & (3 * F.size(F.array_intersect(terms, outside)) <= F.size(terms))
    inside = looked.where("not alone").join(shared.where(F.size(F.split("_segment", " ")) >= 3), (F.col("key") == F.col("_key")) & held)
    every = found(looked.where("decided"), "slot or page").unionByName(found(again, "sentence of several addresses")).unionByName(found(inside, "sentence of several addresses inside another"))
    return every.groupBy("row", "doc_id").agg(F.min("reason").alias("reason")).select("doc_id", "reason")
