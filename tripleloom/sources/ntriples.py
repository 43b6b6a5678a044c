"""N-Triples statements as columns: one strict pattern, parsed terms, and the reasons why a line has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.xsd import LEXICAL, XSD

_BMP = r"(?:[0-9A-Ca-cEFef][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"
#: Escapes of characters; halves of surrogate pairs are none.
UCHAR = rf"\\u{_BMP}|\\U0000{_BMP}|\\U000[1-9A-Fa-f][0-9A-Fa-f]{{4}}|\\U0010[0-9A-Fa-f]{{4}}"
#: Absolute: it begins with a scheme.
IRI = rf"<([A-Za-z][A-Za-z0-9+.-]*+:(?:[^\x00-\x20<>\"{{}}|^`\\]++|{UCHAR})*+)>"
_CHARS_BASE = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
_U = rf"{_CHARS_BASE}_:"
_CHARS = rf"{_U}0-9\x{{B7}}\x{{300}}-\x{{36F}}\x{{203F}}-\x{{2040}}-"
BLANK = rf"(_:[{_U}0-9](?:\.*[{_CHARS}])*+)"
STRING = rf'"((?:[^"\\\n\r]++|\\[tbnrf"\'\\]|{UCHAR})*+)"'
LANG = r"@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)"
LITERAL = rf"{STRING}(?:[ \t]*\^\^[ \t]*{IRI}|[ \t]*{LANG})?"
_S = r"[ \t]*"
_TERM = rf"(?:{IRI}|{BLANK})"
#: Groups: subject IRI, blank; predicate; object IRI, blank, text, datatype, language.
STATEMENT = rf"^{_S}{_TERM}{_S}{IRI}{_S}(?:{_TERM}|{LITERAL}){_S}\.{_S}(?:#[^\n\r]*)?[\r\n]*\z"
NO_STATEMENT = r"^\s*(?:#[^\n\r]*\s*)?\z"

def unescape(text: Column) -> Column:
    """Resolves the escapes of N-Triples; texts without a backslash are left as they are."""
    short = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

    def one(t: Column) -> Column:
        code = F.when(t.startswith("\\u"), F.decode(F.unhex(t.substr(3, 4)), "UTF-16BE")).when(t.startswith("\\U"), F.decode(F.unhex(t.substr(3, 8)), "UTF-32"))
        for k, v in short.items():
            code = code.when(t == "\\" + k, F.lit(v))
        return code.otherwise(t)

    parts = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    return F.when(text.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def parsed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Adds s_kind, s_lex, p_lex, o_kind, o_lex, o_lang, o_dt and well_formed to the columns ``keep``.

    Kinds are I, B and L; parts of lines that aren't one statement are null. A null line isn't well formed."""
    t = F.col(text)
    ok = F.coalesce(t.rlike(STATEMENT), F.lit(False))
    # One replacement gives all groups; no part of a well-formed statement has a line end in it.
    names = ["s_iri", "s_blank", "p", "o_iri", "o_blank", "o_text", "dt", "lang"]
    groups = F.split(F.regexp_replace(t, STATEMENT, "\n".join(f"${i}" for i in range(1, 9))), "\n")
    # A generator keeps filters on the parts above it; pushed below, they would match the pattern once for each mention.
    cut = df.select(*keep, F.explode(F.array(F.struct(ok.alias("ok"), F.when(ok, groups).alias("groups")))).alias("_cut"))
    part = {n: F.col("_cut.groups")[i] for i, n in enumerate(names)}
    raw = cut.select(*keep, F.col("_cut.ok").alias("well_formed"), *(F.when(v != "", v).alias(f"_{n}") for n, v in part.items()))
    literal = F.col("_o_iri").isNull() & F.col("_o_blank").isNull() & F.col("well_formed")
    return raw.select(
        *keep,
        "well_formed",
        F.when(F.col("_s_iri").isNotNull(), "I").when(F.col("_s_blank").isNotNull(), "B").alias("s_kind"),
        unescape(F.coalesce("_s_iri", F.substring("_s_blank", 3, 1 << 30))).alias("s_lex"),
        unescape(F.col("_p")).alias("p_lex"),
        F.when(literal, "L").when(F.col("_o_iri").isNotNull(), "I").when(F.col("_o_blank").isNotNull(), "B").alias("o_kind"),
        unescape(F.when(literal, F.coalesce("_o_text", F.lit(""))).otherwise(F.coalesce("_o_iri", F.substring("_o_blank", 3, 1 << 30)))).alias("o_lex"),
        F.col("_lang").alias("o_lang"),
        unescape(F.col("_dt")).alias("o_dt"),
    )


#: "<local name> <text>" of conforming values, so that one match checks any of the types.
_FITS = "^(?:" + "|".join(f"{n} {p[1:-2]}" for n, p in LEXICAL.items()) + r")\z"


def value_fits(lex: Column, dt: Column) -> Column:
    """False where the datatype is one of the checked XSD types and the text isn't in its lexical space; never null."""
    checked = F.coalesce(dt.isin([XSD + n for n in LEXICAL]), F.lit(False))
    return ~checked | F.concat(F.substring(dt, len(XSD) + 1, 20), F.lit(" "), lex).rlike(_FITS)


def reason(text: Column, lex: Column, dt: Column, well_formed: Column) -> Column:
    """Why a line that is no triple isn't one; the first that applies, in the order of reading."""
    term = rf"(?:{IRI}|{BLANK})"
    loose = r'(?:<[^<>]*>|_:\S*?|"(?:[^"\\]++|\\.)*+"(?:@[\w-]+|\^\^<[^<>]*>)?)'
    return (
        F.when(well_formed, F.concat(F.lit("value outside the lexical space of "), F.element_at(F.split(dt, "#"), -1), F.lit(": "), lex))
        .when(~text.rlike(rf"^{_S}(?:<|_:)"), "subject is neither IRI nor blank node")
        .when(~text.rlike(rf"^{_S}{term}"), "malformed subject")
        .when(~text.rlike(rf"^{_S}{term}{_S}<"), "predicate is missing or no IRI")
        .when(~text.rlike(rf"^{_S}{term}{_S}{IRI}"), "malformed predicate")
        .when(text.rlike(rf"^{_S}{term}{_S}{IRI}{_S}\.?{_S}[\r\n]*\z"), "object is missing")
        .when(text.rlike(rf'^{_S}{term}{_S}{IRI}{_S}"(?:[^"\\]++|\\.)*+\z'), "string isn't closed")
        .when(text.rlike(rf'^{_S}{term}{_S}{IRI}{_S}"') & ~text.rlike(rf"^{_S}{term}{_S}{IRI}{_S}{STRING}"), "bad escape or character in string")
        .when(~text.rlike(rf"^{_S}{term}{_S}{IRI}{_S}(?:{term}|{STRING})"), "malformed object")
        .when(text.rlike(rf"^{_S}{term}{_S}{IRI}{_S}(?:{term}|{LITERAL}){_S}[\r\n]*\z"), "final dot is missing")
        .when(text.rlike(rf"^{_S}{term}{_S}{IRI}{_S}{STRING}[@^]") & ~text.rlike(rf"^{_S}{term}{_S}{IRI}{_S}{STRING}(?:{LANG}|\^\^{IRI}){_S}[.<_\"]"), "malformed language tag or datatype")
        .when(text.rlike(rf"^{_S}{loose}{_S}{loose}{_S}{loose}{_S}{loose}"), "wrong number of terms")
        .otherwise("unexpected text after the object")
    )


#: Compressed files are read by their last ending.
COMPRESSED = ("", ".gz", ".bz2", ".deflate", ".zst")


def globbed(*endings: str) -> str:
    """A pattern of file names with one of the endings, compressed or not."""
    return "*.{" + ",".join(e + c for e in endings for c in COMPRESSED) + "}"


def has_ending(path: str, *endings: str) -> bool:
    return path.endswith(tuple(f".{e}{c}" for e in endings for c in COMPRESSED))


def read_ntriples(spark: SparkSession, path: str, glob: str = globbed("nt", "n3")) -> DataFrame:
    """Lines of N-Triples files with file_name, statement and the parsed columns; a file or a folder, compressed or not."""
    lines = spark.read.option("pathGlobFilter", glob).text(path) if glob else spark.read.text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("stmt"))
    return parsed(lines.where(~F.col("stmt").rlike(NO_STATEMENT)), "stmt", ["file_name", "stmt"])


def to_ntriples(kind: Column, lex: Column, lang: Column, dt: Column) -> Column:
    """A term in N-Triples syntax."""
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(lex, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    literal = F.concat(F.lit('"'), quoted, F.lit('"'), F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("@"), lang)).when(F.coalesce(dt, F.lit("")) != "", F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise(""))
    return F.when(kind == "I", F.concat(F.lit("<"), lex, F.lit(">"))).when(kind == "B", F.concat(F.lit("_:"), lex)).otherwise(literal)
