"""Template residue, filler and error notices by SimHash near-duplicates of trusted residue."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.p05_main import LINK, MARKER, MEMO, SENTENCE_END, SHORT_WORDS
from quillmesh.llm.p05_main import WORD as NAME_WORD
from quillmesh.runtime import cut

SHINGLE, SIMILAR = 5, 0.8
HAMMING = 32  # texts of SIMILAR differ in about 10 of 64 bits, in more than 32 with a chance under 1e-8; other texts in 32
BROADCAST_ROWS = 20_000  # rows of labelled texts that are broadcast in one round; more are joined by a shuffle
FOLD = 10  # rounds after which what is labelled becomes one table again
NOTICE_WORDS = 45
PROVEN, SOLE_SHARE = 3, 0.8  # differently titled records, and share of a line's places, that prove a line to be residue

# How templates mark what they fill in, and what failed fill-ins leave.
NAME = r"[A-Za-z][\w.]{0,40}"
PLACEHOLDER = re.compile(
    rf"\{{\{{-?\s*{NAME}\s*-?\}}\}}|\$\{{\s*{NAME}\s*\}}|\{{%-?\s*{NAME}\s*-?%\}}|<%=?\s*{NAME}\s*%>|(?<![{{$\w])\{{{NAME}\}}(?!\}})|(?<![\w%])%{NAME}%(?![\w%])"
    rf"|(?<![\w#])#[A-Za-z][A-Za-z_.]{{1,40}}#(?![\w#])|@@{NAME}@@|(?<![\w_])__[A-Za-z][A-Za-z_.]*?__(?![\w_])|\[\[{NAME}\]\]|\bXXX_\w+?_XXX\b"
    r"|\[(?:insert|your|enter|add) [^\[\]]{1,40}\]|<(?:insert|your|enter) [^<>]{1,40}>|\[object Object\]|\bnull null\b|\bundefined\b|\bNaN\b",
    re.I,
)
HINT = re.compile(r"[{%\[<$]|#(?=[A-Za-z])|@@|__|XXX|xxx|[Nn]ull|[Uu]ndefined|NaN")
FAILED = re.compile(r"undefined|nan", re.I)
QUOTED = re.compile(r"`[^`]*`|\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|«[^»\n]{0,200}»|„[^“”\n]{0,200}[“”]|```.*?(?:```|\Z)|<code>.*?</code>", re.S)

# Words of pseudo-Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "sagittis viverra porta sodales placerat fermentum integer rutrum augue semper cursus felis donec ligula nullam mauris pretium nisl quisque egestas vitae aliquam".split()
)
# Lines that are residue beyond doubt, from which labels spread.
NOTICES = (
    "404 – Page not found. The address you requested does not exist on this server.", "This page is no longer available. It may have been moved or deleted.", "Access denied. You do not have permission to view this resource.",
    "Please enable JavaScript to continue using this application.", "Your browser does not run scripts, so nothing can be shown.", "The service is temporarily unavailable for maintenance.", "Something went wrong on our end. Please try again in 5 minutes.",
    "404 – Seite nicht gefunden. Die angeforderte Adresse gibt es auf diesem Server nicht.", "Zugriff verweigert. Sie haben keine Berechtigung für diese Seite.", "Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "Ihr Browser führt keine Skripte aus, daher kann hier nichts angezeigt werden.",
    "Erreur 404 : la page demandée est introuvable sur ce serveur.", "Accès refusé. Vous n'avez pas le droit de consulter cette page.", "404 – Pagina niet gevonden. Het gevraagde adres bestaat niet op deze server.", "Zet JavaScript aan om deze pagina te gebruiken.", "Ative o JavaScript para usar esta página.",
)
FILLERS = ("This is sample text. Replace it with your own content.", "Text goes here.", "Content coming soon.", "Este é um texto de exemplo. Troque pelo seu conteúdo.")
# Titles that pages take for a notice, not for content.
NOTICE_TITLE = re.compile(r"\W*(?:error|just a moment|access denied|forbidden|not found|page not found|attention required|service unavailable|bad gateway|gateway timeout|[45]\d\d)(?:\W+\d{3})?\W*", re.I)

# Stems of consent, newsletter, advertising, sharing and comment lines, by language.
CONSENT = re.compile(
    r"\b(?:use|uses|using|store|stores|verwenden|nutzen|speichern|utilisons|utilizamos|usamos|gebruiken|используем)\b[^.!?]{0,40}\b(?:cookies?|small files|kleine dateien)"
    r"|\b(?:cookies|files|dateien|fichiers|archivos|arquivos|ficheiros|bestanden|файлы|cookie)\b[^.!?]{0,12}\b(?:are (?:needed|necessary)|sind (?:notwendig|nötig)|sont nécessaires|son necesari[ao]s|são necessários|zijn noodzakelijk|необходимы)"
    r"|\bby continuing\b|mit der weiteren nutzung|durch die weitere nutzung|\ben poursuivant\b|si contin[uú]a navegando|\bao continuar\b|als u verder|\bпродолжая\b"
    r"|\b(?:change|withdraw) your (?:choice|consent|settings)|ihre auswahl jederzeit|modifier votre choix|cambiar su elección|(?:alterar|mudar) a sua (?:escolha|opção)|uw keuze\b|изменить (?:свой )?выбор"
    r"|\bour partners may use|unsere partner\b|nos partenaires|nuestros socios|nossos parceiros|onze partners|наши партн[её]ры"
    r"|\b(?:cookie|privacy) policy\b|stores small files",
    re.I,
)
INSERT = re.compile(
    r"^\W*(?:advertisement|sponsored|anzeige|werbung|publicité|publicidade?|anuncio|anúncio|advertentie|реклама)\W*$"
    r"|\b(?:subscribe|sign up|abonnieren|bestellen|melden sie sich|abonnez|inscrivez|suscríbase|suscríbete|assine|inscreva|meld u aan|schrijf u in|подпишитесь)\b.*\b(?:newsletter|lettre d'information|infolettre|boletín|boletim|nieuwsbrief|рассылк\w*)"
    r"|^\W*(?:share|teilen|partager|compartir|compartilhar|delen|поделиться)\b.{0,30}[:·]"
    r"|^\W*\d+ (?:comments?|kommentare?|commentaires?|comentarios?|comentários?|reacties?|комментари\w*)\b"
    r"|^\W*(?:estimated reading time|reading time|lesezeit|temps de lecture|tiempo de lectura|tempo de leitura|leestijd|время чтения)\b"
    r"|^\W*(?:tags|schlagwörter|étiquettes|etiquetas|trefwoorden|метки|теги)\s*:"
    r"|^\W*rate this article|^\W*follow us on|^\W*(?:back to top|nach oben|haut de page|volver arriba|voltar ao topo|naar boven|наверх)\W*$"
    r"|\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|todos os direitos reservados|alle rechten voorbehouden|все права защищены)"
    r"|^\W*(?:©|copyright\b)|\b(?:may be reused without permission|made with care by)\b",
    re.I,
)
TEASER = re.compile(
    r"^\W*(?:related articles?|more from this section|most read(?: this week)?|you may also like|read (?:also|more|next)|ähnliche beiträge|das könnte sie auch interessieren|mehr aus (?:dieser|diesem)|lesen sie auch|meistgelesen|"
    r"articles liés|à lire aussi|lire aussi|les plus lus|vous aimerez aussi|artículos relacionados|también le puede interesar|lea también|lo más leído|más leídas?|leia também|mais lid[ao]s|artigos relacionados|veja também|"
    r"lees ook|meest gelezen|gerelateerde artikelen|meer uit deze|читайте также|самое популярное|похожие статьи|ещё из раздела)\b",
    re.I,
)

LONG = 140  # code points from which a line that begins like prose is prose unless it asks for consent
# One of these stands in every line that CONSENT can match.
STEMS = (
    "cookie", "files are", "small files", "dateien", "fichiers", "archivos son", "arquivos são", "ficheiros", "bestanden", "файлы", "by continuing", "nutzung", "en poursuivant", "continúa nav", "continua nav", "ao continuar", "als u verder", "продолжая",
    "your choice", "your consent", "your settings", "auswahl", "votre choix", "su elección", "sua escolha", "sua opção", "keuze", "выбор", "partners may", "unsere partner", "partenaires", "nuestros socios", "parceiros", "onze partners", "партн", "cookie policy", "privacy policy",
)


def automaton(stems: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds any of the stems in one pass over a text."""
    a = ahocorasick.Automaton()
    for stem in stems:
        a.add_word(stem, stem)
    a.make_automaton()
    return a


def any_in(a: ahocorasick.Automaton, text: str) -> bool:
    return next(a.iter(text), None) is not None


_stems = automaton(STEMS)
_prose: dict[str, bool] = {}



def is_prose(line: str) -> bool:
    """Whether a line is content by its own marks: a sentence that is no consent, teaser, inserted or marked line."""
    text = line.strip()
    if len(text) >= LONG and text[0].isalpha() and text[-1] in ".!?…" and not any_in(_stems, text.lower()):
        return True
    known = _prose.get(text)
    if known is None:
        if len(_prose) >= MEMO:
            _prose.clear()
        known = _prose[text] = _is_prose(text)
    return known


def _is_prose(text: str) -> bool:
    n = len(NAME_WORD.findall(text))
    marker = MARKER.match(text)
    if n < 5 or marker or not SENTENCE_END.search(text) or text[0] == "#" or (text[0] == "|" and text[-1] == "|") or TEASER.match(text):
        return False
    if n <= 3 * SHORT_WORDS and INSERT.search(text) and len(SENTENCE_END.findall(text)) <= 1:
        return False
    parts = [p for p in re.split(r"(?<=[.!?…])\s+", text) if p]
    if any_in(_stems, text.lower()) and CONSENT.search(text) and 2 * sum(1 for p in parts if CONSENT.search(p)) > len(parts):
        return False
    return not (LINK.search(text) and not LINK.sub("", text).strip(" *-•»›"))


WORD = re.compile(r"\w+")
NONE, PLACED, FILLED, NOTICED = 0, 1, 2, 3
_codes: dict[str, int] = {}


def placeholders(text: str) -> bool:
    """Whether an unfilled placeholder stands in a value's place, outside code and quotation."""
    if not HINT.search(text):
        return False
    at = [m.start() for m in HINT.finditer(text)]
    if not any(PLACEHOLDER.match(text, i) for i in at):
        return False
    bare = QUOTED.sub(" ", text) if any(q in text for q in "`\"“«„") or "<code>" in text else text
    return any(not (FAILED.fullmatch(m[0]) and m[0] not in ("undefined", "NaN")) for m in PLACEHOLDER.finditer(bare))


def trusted(words: list[str]) -> int:
    """FILLED for a line of pseudo-Latin."""
    n = len(words)
    return FILLED if n >= 5 and sum(w in LATIN for w in words[:12]) >= 4 and sum(w in LATIN for w in words) >= 0.7 * n else NONE


def shingles(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct hashes of each unit's shingles of SHINGLE words (all words of a shorter unit), ascending within a unit."""
    if len(_codes) > 1 << 20:
        _codes.clear()
    flat = [w for ws in words for w in ws]
    get = _codes.get
    ids = np.fromiter((get(w) or _codes.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in flat), np.uint64, len(flat))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    mixed = np.zeros(len(ids), np.uint64)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(ids))  # words from here to the unit's end
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            shifted = np.roll(ids, -k)
            mixed = np.where(left > k, mixed * np.uint64(0x9E3779B97F4A7C15) + shifted, mixed)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    whole = left >= np.minimum(np.repeat(sizes, sizes), SHINGLE)  # shingles that are complete
    mixed, owner = mixed[whole], np.repeat(np.arange(len(words)), sizes)[whole]
    order = np.lexsort((mixed, owner))
    mixed, owner = mixed[order], owner[order]
    first = np.ones(len(mixed), bool)
    first[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    return mixed[first], np.bincount(owner[first], minlength=len(words))


def codes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash codes of units by their shingles' hashes."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    begins, counts = (np.cumsum(sizes) - sizes)[some], sizes[some]
    for a in range(0, len(some), 4096):
        b = min(a + 4096, len(some))
        lo, hi = begins[a], begins[b - 1] + counts[b - 1]
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, begins[a:b] - lo, axis=0, dtype=np.int32)
        out[some[a:b]] = np.packbits(2 * ones > counts[a:b, None], axis=1).view(np.uint64).ravel()
    return out.view(np.int64)


def simhash(words: list[list[str]]) -> np.ndarray:
    """64-bit codes of many units at once over their distinct shingles."""
    return codes(*shingles(words))


def once_said(words: list[str]) -> str | None:
    """The words that a line says over and over, two times or more, else null; they are three or more."""
    n = len(words)
    for period in range(3, n // 2 + 1):
        if words[period] == words[0] and n % period == 0 and words[period:] == words[:-period]:
            return " ".join(words[:period])
    return None


def normal(unit: str) -> str:
    return re.sub(r"\d+", "0", unit.lower()) if any(c.isdigit() for c in unit) else unit.lower()


def units_of(records: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """(key, no, label, prose, alone, again, about, unit): the non-blank lines of each record.

    unit is the line's words, lower-case and with digits masked. label is the trusted one:
    pseudo-Latin, or the only content of a record whose title is that of a notice. prose marks
    lines that are content in their own right, alone the short one that is its record's only
    content, again lines that say the same over and over (unit holds it once); about is the
    hash of the record's title.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(title).alias("ti"))
    kinds = [pa.int64(), pa.int32(), pa.int8(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.string()]
    names = [key, "no", "label", "prose", "alone", "again", "about", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ks, nos, labels, proses, alones, agains, abouts, texts, sizes = [], [], [], [], [], [], [], [], []
                for k, t, ti in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    lines = t.split("\n") if t else []
                    fences = t and "```" in t
                    fenced = False
                    marked = bool(t) and placeholders(t) or bool(ti) and placeholders(ti)
                    if marked:  # one row says so for the record
                        ks.append(k), nos.append(-2), labels.append(PLACED), proses.append(False), agains.append(False), texts.append(""), sizes.append(0)
                    at_first, content = len(ks), []
                    for no, line in enumerate(lines):
                        if fences and line.lstrip().startswith("```"):
                            fenced = not fenced
                            continue
                        unit = line.strip()
                        if not unit or fenced:
                            continue
                        low = normal(unit)
                        ws = WORD.findall(low)
                        label = trusted(ws)
                        said = None if label or unit[0] in "|#" else once_said(ws)
                        again, low = said is not None, said or " ".join(ws) or low
                        prose = not label and (len(ws) > 60 or is_prose(unit))
                        if prose or label:
                            content.append(len(ks))
                        ks.append(k), nos.append(no), labels.append(label), proses.append(prose), agains.append(again), texts.append(low), sizes.append(len(ws))
                    alones += [False] * (len(ks) - len(alones))
                    abouts += [(xxhash.xxh64_intdigest(ti or "") >> 1)] * (len(ks) - len(abouts))
                    if len(content) == 1 and content[0] >= at_first and proses[content[0]] and sizes[content[0]] <= NOTICE_WORDS:
                        alones[content[0]] = True
                    if ti and len(content) <= 1 and len(ks) > at_first and NOTICE_TITLE.fullmatch(ti):  # what the title speaks of: its content, or its longest line
                        about = content[0] if content else max(range(at_first, len(ks)), key=lambda i: sizes[i])
                        if 2 < sizes[about] <= NOTICE_WORDS and not labels[about]:
                            labels[about] = NOTICED
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((ks, nos, labels, proses, alones, agains, abouts, texts), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"{key} bigint, no int, label tinyint, prose boolean, alone boolean, again boolean, about bigint, unit string")


def _tokens(units: list[str]) -> list[list[str]]:
    """Words of units; a unit without any is its own word."""
    return [WORD.findall(u) or [u] for u in units]


def prefixes(texts: DataFrame) -> DataFrame:
    """Adds (n, sim, prefix): number of shingles, SimHash code, and the least shingle hashes.

    Of two texts whose shingles are SIMILAR, each holds at least that share of its own in
    common. So a text may lack n - ceil(SIMILAR * n) of its shingles, and among one more than
    that, the least by hash on both sides, there is always a common one.
    """
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                hashes, sizes = shingles(_tokens(batch.column("unit").to_pylist()))
                most = sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(np.int64) + 1
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[place < np.repeat(most, sizes)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(codes(hashes, sizes)), prefix], names=[*batch.schema.names, "n", "sim", "prefix"])

    return texts.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", n int, sim bigint, prefix array<bigint>")


def alike(pairs: DataFrame) -> DataFrame:
    """(u, got) of those pairs (u, got, unit, other) whose shingles have a Jaccard similarity of SIMILAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = []
                for side in ("unit", "other"):
                    hashes, sizes = shingles(_tokens(batch.column(side).to_pylist()))
                    sets.append(np.split(hashes, np.cumsum(sizes)[:-1]))
                same = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets, strict=True)]
                good = [n >= SIMILAR * (len(a) + len(b) - n) for n, a, b in zip(same, *sets, strict=True)]
                yield batch.select(["u", "got"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("u", "got", "unit", "other").mapInArrow(run, "u bigint, got tinyint").distinct()


def labelled_units(units: DataFrame, key: str) -> DataFrame:
    """Trusted labels carried through the near-duplicate graph: (key, no, label).

    Trusted are the seeds NOTICES and FILLERS, lines of pseudo-Latin, the only content of
    records with the title of a notice, and lines that the corpus proves to be residue.

    Round by round the newly labelled texts are joined with all unlabelled ones on the least
    of their shingles (no similar pair can miss, see prefixes), compared by number of shingles
    and SimHash code, verified by the Jaccard similarity of their shingles, and take over the
    label, until a round adds nothing: exactly the components that hold a trusted text are
    walked. Each text is compared once, however many lines hold it.
    """
    hint = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    # A short line that is the whole content of differently titled records and hardly stands elsewhere is a notice.
    sole = cut(units.where("alone").groupBy("unit").agg(F.countDistinct("about").alias("n"), F.count("*").alias("times")).where(F.col("n") >= PROVEN))
    places = units.join(hint(sole), "unit").groupBy("unit").agg(F.max("times").alias("times"), F.count("*").alias("places"))
    noticed = places.where(F.col("times") >= SOLE_SHARE * F.col("places")).select("unit", F.lit(NOTICED).alias("proof"))
    # A line that only repeats one sentence, the same in differently titled records, is filler.
    said = units.where("again").groupBy("unit").agg(F.countDistinct("about").alias("n")).where(F.col("n") >= PROVEN).select("unit", F.lit(FILLED).alias("proof"))
    proven = cut(noticed.unionByName(said).groupBy("unit").agg(F.max("proof").cast("tinyint").alias("proof")))
    lines = units.where(f"label in ({NONE}, {FILLED}, {NOTICED}) and unit <> ''")
    each = lines.groupBy("unit").agg(F.max("label").alias("label"), F.max(F.col("label") == NONE).alias("open"))
    each = each.join(hint(proven), "unit", "left").select("unit", "open", F.greatest("label", F.when(F.col("open"), F.col("proof"))).alias("got"))
    seeds = units.sparkSession.createDataFrame([(" ".join(WORD.findall(normal(x))), False, got) for xs, got in ((NOTICES, NOTICED), (FILLERS, FILLED)) for x in xs], "unit string, open boolean, got byte")
    # A seed is a text of its own, linked to those like it as any other.
    texts = cut(prefixes(each.select("unit", "open", F.col("got").cast("tinyint").alias("got")).unionByName(seeds).withColumn("u", F.monotonically_increasing_id())))
    tokens = texts.where("open").select("u", "n", "sim", F.explode("prefix").alias("tok"))
    front = cut(texts.where(f"got <> {NONE}").select("u", "got"))
    seen, rounds = front, 0
    while n := front.count():
        known = front.join(texts.drop("got"), "u") if n > BROADCAST_ROWS else F.broadcast(front).join(texts.drop("got"), "u")
        known = cut(known.select(F.col("u").alias("f"), "got", F.col("n").alias("fn"), F.col("sim").alias("fs"), F.col("unit").alias("other"), "prefix"))
        asked = known.select("f", "got", "fn", "fs", F.explode("prefix").alias("tok"))
        near = tokens.join(hint(asked), "tok").where(
            (F.col("u") != F.col("f")) & (F.col("n") >= SIMILAR * F.col("fn") - 1e-9) & (F.col("fn") >= SIMILAR * F.col("n") - 1e-9) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("fs"))) <= HAMMING)
        )
        near = cut(near.select("u", "f", "got").distinct().join(seen, ["u", "got"], "left_anti"))
        met = texts.select("u", "unit").join(hint(near), "u").join(known.select("f", "got", "other"), ["f", "got"])
        front = cut(alike(met))
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % FOLD == 0:
            seen = cut(seen)
    reached = cut(seen.groupBy("u").agg(F.max("got").alias("got")).join(texts.where("open").select("u", "unit"), "u").select("unit", "got"))
    found = lines.where(f"label <> {NONE}").select(key, "no", "label").unionByName(lines.where(f"label = {NONE}").join(hint(reached), "unit").select(key, "no", F.col("got").alias("label")))
    return found.groupBy(key, "no").agg(F.max("label").alias("label"))


def residue(records: DataFrame, key: str = "extraction_id", text: str = "text", title: str = "title") -> DataFrame:
    """(key, why) of the records with a placeholder (in text or title), a filler passage, or a notice in place of content.

    A labelled notice counts only where no line of the record is content of its own. Null
    texts and titles are empty; null keys give no rows; repeated rows of a key count once; code
    and quotations are not searched for placeholders. Very long texts are read whole.
    """
    units = cut(units_of(records, key, text, title))
    labels = labelled_units(units, key)
    placed = units.where(f"label = {PLACED}").select(key, F.lit("placeholder").alias("why"))
    filled = labels.where(f"label = {FILLED}").select(key, F.lit("filler").alias("why"))
    notices = labels.where(f"label = {NOTICED}").select(key, "no").distinct()
    content = units.where("prose").select(key, "no").join(notices.select(key).distinct(), key, "left_semi").join(notices, [key, "no"], "left_anti").select(key)
    noticed = notices.select(key).distinct().join(content, key, "left_anti").select(key, F.lit("notice").alias("why"))
    return placed.unionByName(filled).unionByName(noticed).groupBy(key).agg(F.min("why").alias("why"))


def usable(extractions: DataFrame, kinds: tuple[str, ...] = ("html", "docs", "text")) -> DataFrame:
    """Successes of the kinds that can hold residue."""
    return extractions.where((F.col("status") == "success") & F.col("kind").isin(*kinds)).select("extraction_id", "title", "text")
