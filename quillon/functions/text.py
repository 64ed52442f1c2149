"""Text functions as Column expressions; nothing here leaves the JVM but Unicode composition.

Every function takes and returns Columns. A null text gives null unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS_PER_WORD = 1.33
WORD = r"[\p{L}\p{N}_]+"
_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_BEYOND_LATIN = r"[^\x{0}-\x{2FF}]"
_UPPER = "A-ZÁÉÍÓÚÀÂÊÔÃÕÇ"

# Words left out of ranking tokens.
RANKING_STOPWORDS = """
a o e é de do da dos das em no na nos nas por para com um uma uns umas se que ao aos às ou mas também já mais como seu sua seus suas
este esta estes estas esse essa esses essas isso aqui ali quando onde há ter ser estar foi são era tem não the of and in to is it that
for on are fazer feito faz fazia faça pode podem deve devem dever usar usado precisa precisar preciso quero quer querer saber sabe dizer
disse diz ver veja vai vão ir dar dá dado tudo todo toda todos todas muito muita muitos muitas pouco pouca poucos cada qual quais quem
cujo cuja cujos cujas mesmo mesma apenas ainda então assim pois sobre entre após antes durante contra desde até pelo pela pelos pelas
num numa nuns numas funciona funcionam funcionava funcionavam funcionar significa significam significava significar existe existem existia
existiam existir acontece acontecem aconteceu aconteciam acontecer chama chamado chamada chamam chamava explica explicam explicar explicou
""".split()
# Words left out of topic keywords.
TOPIC_STOPWORDS = """
a o e é de do da em no na por para com um uma se que ao ou mas como não foi são era tem ser ter isso esse esta the of and in to is it
for on are me eu tu ele ela nos eles elas você vocês qual quais quem quando onde quanto seu sua meu minha nosso nossa
""".split()
# Words left out of evaluation keywords.
EVALUATION_STOPWORDS = """
a o e é de do da em no na por para com um uma se que ao ou mas como não foi são era tem ser ter isso esse esta the of and in to is it
for on are dos das seu sua seus suas este estes estas aqui ali quando onde há dizer fazer ver
""".split()
# Editorial notices deleted from page texts.
BOILERPLATE = (
    r"(?isu)©\s*\d{4}.*?todos\s+os\s+direitos\s+reservados",
    r"(?iu)copyright\s*©?\s*\d{4}",
    r"(?iu)isbn\s*:?\s*[\d\-]+",
    r"(?iu)reprodução\s+proibida",
    r"(?iu)todos\s+os\s+direitos\s+reservados",
    r"(?iu)editora\s+moderna\s+ltda",
    r"(?iu)impresso\s+no\s+brasil",
    r"(?iu)printed\s+in\s+brazil",
    r"(?iu)ficha\s+catalográfica",
    r"(?iu)catalogação\s+na\s+fonte",
    r"(?iu)dados\s+internacionais\s+de\s+catalogação",
    r"(?iu)cip\s*-\s*brasil",
    r"(?iu)sumário",
    r"(?iu)índice\s+remissivo",
)
# What an answer says when the context does not hold it.
REFUSAL = "Não consigo te ajudar com isso. Se quiser ajuda nos estudos é só chamar!"
REFUSAL_MARKERS = ("não está no material", "não consigo te ajudar com isso")
OLD_REFUSAL = "Esse conteúdo não está no material"
# Signs of a definition in a sentence.
DEFINITION_MARKERS = ("é ", "são ", "consiste", "define", "significa", "representa", "refere", "denomina", "caracteriza", "utiliza", "permite", "ocorre", "resulta")
# How an echoed prompt begins.
PROMPT_ECHOES = ("você é um professor", "voce e um professor", "regras:", "contexto:")


def words_of(text: Column) -> Column:
    """Runs without white space of any kind."""
    return F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def tokens_of(words: Column) -> Column:
    """Words times 1.33 cut to an integer, at least 1."""
    return F.greatest(F.lit(1), (words * F.lit(TOKENS_PER_WORD)).cast("int"))


def count_tokens(text: Column) -> Column:
    """Words times 1.33 cut to an integer, at least 1; 0 for the empty text and for null."""
    return F.when(text.isNull() | (text == ""), 0).otherwise(tokens_of(F.size(words_of(text))))


def tokens(text: Column, stopwords: list[str] | None = None, min_length: int = 1) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order and with repeats."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if not stopwords and min_length <= 1:
        return found
    # a literal list becomes a hash set, an array would be searched from its start
    keep = lambda x: F.length(x) >= min_length if not stopwords else (F.length(x) >= min_length) & ~x.isin(*stopwords)
    return F.filter(found, keep)


def ranking_tokens(text: Column) -> Column:
    return tokens(text, RANKING_STOPWORDS, 3)


def topic_keywords(text: Column) -> Column:
    return F.array_distinct(tokens(text, TOPIC_STOPWORDS, 4))


def compose(text: Column) -> Column:
    """Canonical composition; only texts with a combining mark or beyond Latin leave the JVM."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    # the others are sent as nulls, as a function is called for every row
    return F.coalesce(nfc(F.when(text.rlike(_BEYOND_LATIN), text)), text)


def compose_all(texts: Column) -> Column:
    """``compose`` for an array of texts."""

    @F.pandas_udf("array<string>")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: [None if x is None else unicodedata.normalize("NFC", x) for x in xs], na_action="ignore")

    return F.coalesce(nfc(F.when(F.exists(texts, lambda x: x.rlike(_BEYOND_LATIN)), texts)), texts)


def clean_page_text(text: Column, remove_headers: bool = True, remove_boilerplate: bool = True, composed: bool = False) -> Column:
    """Page text freed of notices, line-end hyphens, soft line breaks, page numbers, capital lines and surplus space.

    The order of the steps is part of the result: a page number behind a line of text joins it
    before lone numbers are deleted. ``composed`` says that the text is in canonical form.
    """
    t = text if composed else compose(text)
    if remove_boilerplate:
        t = reduce(lambda acc, p: F.regexp_replace(acc, p, ""), BOILERPLATE, t)
    t = F.regexp_replace(t, rf"([\p{{L}}\p{{N}}_])-{_SPACE}*\n{_SPACE}*([\p{{L}}\p{{N}}_])", "$1$2")
    t = F.regexp_replace(t, r"(?<=[^\n])\n(?=[a-záéíóúàâêôãõç0-9,;:\"'])", " ")
    t = F.regexp_replace(t, rf"(?md)^{_SPACE}*\d{{1,4}}{_SPACE}*$", "")
    if remove_headers:
        t = F.regexp_replace(t, rf"(?md)^(?:[{_UPPER}]|{_SPACE}){{5,60}}$", "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts between an end mark with white space and a capital, quote or parenthesis."""
    parts = F.split(strip(text), rf"(?<=[.!?…]){_SPACE}+(?=[{_UPPER}\"(])")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def plain_sentences(text: Column, longer_than: int) -> Column:
    """Parts between an end mark and white space that are longer than so many characters."""
    return F.filter(F.transform(F.split(strip(text), rf"(?<=[.!?]){_SPACE}+"), strip), lambda p: F.length(p) > longer_than)


def detect_section(text: Column) -> Column:
    """The first title-like line if it has at most 12 words, else null."""
    line = strip(F.regexp_extract(text, rf"(?md)^(?:\d+[.)]{_SPACE}+)?[{_UPPER}][^\n]{{3,79}}(?<![.!?,;:])$", 0))
    return F.when((line != "") & (F.size(words_of(line)) <= 12), line)


def chapter_of(text: Column) -> Column:
    """The first mention of a numbered chapter in the first 200 characters."""
    return F.nullif(strip(F.regexp_extract(F.substring(text, 1, 200), rf"(?iu)cap(?:ítulo)?\.?{_SPACE}+(\d+|[IVX]+)", 0)), F.lit(""))


def topic_of(text: Column) -> Column:
    """The first of five lines with 10 to 80 characters and no end mark."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), strip)
    return F.get(F.filter(lines, lambda x: F.length(x).between(10, 80) & ~x.rlike(r"[.!?]$")), F.lit(0))


def section_title_of(text: Column, section: Column) -> Column:
    return F.coalesce(F.nullif(section, F.lit("")), topic_of(text))


def chunk_id(source: Column, index: Column, page: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of source, index and page."""
    tail = F.when(page.isNotNull(), F.concat(F.lit("::page"), page.cast("int").cast("string"))).otherwise("")
    return F.substring(F.sha1(F.concat(source, F.lit("::"), index.cast("string"), tail)), 1, 16)


def text_hash(text: Column) -> Column:
    return F.md5(text)


def embedding_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("::", model, text), 256)


def record_key(chunk_id_: Column, text: Column) -> Column:
    """The chunk id, or the first 64 characters of the text where it is null or empty."""
    return F.coalesce(F.nullif(chunk_id_, F.lit("")), strip(F.substring(text, 1, 64)))


def breadcrumb(*levels: Column) -> Column:
    """Levels joined by " > " without null or empty ones."""
    return F.concat_ws(" > ", *[F.nullif(c, F.lit("")) for c in levels])


def looks_like_heading(text: Column) -> Column:
    return F.length(text).between(4, 120) & text.rlike(r"^[\p{Lu}\p{Nd}]") & (F.size(words_of(text)) <= 20)


def line_level(line: Column, font_size: Column | None = None, body_size: Column | None = None) -> Column:
    """Outline level of a line: 1 unit, 2 chapter, 3 topic, 0 text.

    ``font_size`` is that of a line wholly in bold, null or 0 for others.
    """
    t = strip(line)
    number = r"(?:[IVXLCDM]+|\d+)"
    edge = r"(?![\p{L}\p{N}_])"
    unit = rf"(?iu)^(?:UNIDADE|M[ÓO]DULO|PARTE){_SPACE}+{number}{edge}"
    chapter = rf"(?iu)^CAP[ÍI]TULO{_SPACE}+{number}{edge}{_SPACE}*[:\-–—]?(?:{_SPACE}+[{_UPPER}][^\n]{{0,80}})?$"
    numbered = rf"^\d{{1,2}}\.\d{{1,2}}(?:\.\d{{1,2}})?{_SPACE}+[{_UPPER}]"
    lettered = rf"^[a-z]\){_SPACE}+[{_UPPER}][^\n]{{8,}}$"
    special = rf"(?iu)^(?:EM PAUTA|TRABALHO COM FONTES|TRABALHO E JUVENTUDES|ESTRATÉGIA DE ESTUDO){_SPACE}+[{_UPPER}]"
    digits = F.length(t) - F.length(F.regexp_replace(t, r"\p{Nd}", ""))
    capitals = (
        t.rlike(rf"^(?:[{_UPPER}\-–—:,0-9]|{_SPACE}){{4,100}}$")
        & ~t.rlike(r"[,;:()\[\]]|\.{2,}")
        & (F.size(words_of(t)) <= 12)
        & (F.length(t) >= 10)
        & (digits < F.length(t) * 0.3)
    )
    level = F.when((F.length(t) < 3) | t.rlike(r"^\p{Nd}{1,4}$"), 0).when(t.rlike(unit), 1).when(t.rlike(chapter), 2)
    level = level.when(t.rlike(numbered) | t.rlike(lettered) | t.rlike(special), 3)
    if font_size is not None:
        bold = (F.coalesce(font_size, F.lit(0.0)) > 0) & looks_like_heading(t)
        level = level.when(bold, F.when(font_size >= F.coalesce(body_size, F.lit(12.0)) * 1.2, 1).otherwise(3))
    return F.when(line.isNull(), 0).otherwise(level.when(capitals, 2).otherwise(0))


def clean_heading(line: Column) -> Column:
    """Without a dotted leader and a page number at the end."""
    t = F.regexp_replace(line, rf"(?s){_SPACE}*\.{{3,}}.*$", "")
    return strip(F.regexp_replace(t, rf"{_SPACE}+\d{{1,4}}{_SPACE}*$", ""))


def drop_thoughts(text: Column) -> Column:
    """Without reasoning blocks, the last of which may be left open."""
    t = strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    return strip(F.regexp_replace(t, r"(?is)<think>.*$", ""))


def clean_answer(answer: Column, message: Column) -> Column:
    """A model's answer without reasoning and echoes of the prompt; the refusal where nothing is left."""
    t = drop_thoughts(strip(F.coalesce(answer, F.lit(""))))
    t = strip(F.regexp_replace(t, rf"(?isu)^.*?\[INSTRUÇÃO IMPORTANTE:.*?\]{_SPACE}*", ""))
    said = F.coalesce(message, F.lit(""))
    echoed = (said != "") & F.startswith(F.lower(t), F.lower(said))
    t = F.when(echoed, F.regexp_replace(F.substring(t, F.length(said) + 1, F.length(t)), r"^[ \n\r\t:\-]+|[ \n\r\t:\-]+$", "")).otherwise(t)
    prompt = reduce(lambda acc, p: acc | F.startswith(F.lower(t), F.lit(p)), PROMPT_ECHOES, F.lit(False))
    return F.when((t == "") | prompt, REFUSAL).otherwise(t)


def clean_title(text: Column, longest: int = 60) -> Column:
    t = F.regexp_replace(F.replace(drop_thoughts(strip(F.coalesce(text, F.lit("")))), F.lit("\n"), F.lit(" ")), r"^[ \"'“”.\-]+|[ \"'“”.\-]+$", "")
    return F.when(F.length(t) > longest, F.concat(F.regexp_replace(F.substring(t, 1, longest), f"{_SPACE}+$", ""), F.lit("…"))).otherwise(t)


def clean_question(raw: Column) -> Column:
    """The first line of a generated question, null unless it has 8 characters and a question mark."""
    first = F.get(F.filter(F.transform(F.split(drop_thoughts(raw), r"\r\n|[\n\r]"), strip), lambda x: x != ""), F.lit(0))
    t = F.regexp_replace(F.regexp_replace(first, rf"(?iu)^pergunta{_SPACE}*:?{_SPACE}*", ""), r"^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", "")
    return F.when((F.length(t) >= 8) & F.contains(t, F.lit("?")), t)


def parse_bool(word: Column, default: bool | None) -> Column:
    """A flag from a word; null and words that are none give the default."""
    t = F.lower(strip(word))
    return F.when(t.isin("1", "true", "yes", "on", "sim"), True).when(t.isin("0", "false", "no", "off", "não", "nao"), False).otherwise(F.lit(default).cast("boolean"))


def preview(text: Column, longest: int = 200) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)


def prompt_status(text: Column, prompt: Column, any_usable: Column, min_chars: int = 80) -> Column:
    """Whether a chunk was filtered as too short, stands in the prompt, was cut or is left out."""
    t = strip(text)
    return (
        F.when((F.length(t) < min_chars) & any_usable, "filtered")
        .when((t != "") & F.contains(prompt, t), "in prompt")
        .when((t != "") & F.contains(prompt, F.substring(t, 1, 60)), "cut")
        .otherwise("out")
    )


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda acc, p: acc | F.contains(text, F.lit(p)), parts, F.lit(False))


def is_refusal(answer: Column) -> Column:
    return contains_any(F.lower(answer), REFUSAL_MARKERS)


def plain_digits(text: Column) -> Column:
    """Lower case, subscripts as digits."""
    return F.lower(F.translate(text, "₀₁₂₃₄₅₆₇₈₉", "0123456789"))


def expected_found(answer: Column, expected: Column, empty: bool = True) -> Column:
    """Whether any expected string stands in the answer; ``empty`` for an empty or null list."""
    hit = F.exists(expected, lambda e: F.contains(plain_digits(answer), F.lower(e)))
    return F.when(expected.isNull() | (F.size(expected) == 0), F.lit(empty)).otherwise(F.coalesce(hit, F.lit(False)))


def long_words(text: Column, min_length: int = 4) -> Column:
    return F.array_distinct(tokens(text, None, min_length))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays, 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def word_overlap(a: Column, b: Column, min_length: int = 4) -> Column:
    return jaccard(long_words(a, min_length), long_words(b, min_length))


def confidence(score: Column, high: float = 0.65, low: float = 0.45) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")
