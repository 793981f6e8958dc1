"""Content classification, deterministic naming, ordering, sampling and benchmark roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import ranges

# Magic prefixes, in order: prefix, kind, extension, confidence.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "png", "png", "high"), (b"\xff\xd8\xff", "jpeg", "jpg", "high"), (b"GIF87a", "gif", "gif", "high"), (b"GIF89a", "gif", "gif", "high"),
    (b"%PDF-", "pdf", "pdf", "high"), (b"\x1f\x8b\x08", "gzip", "gz", "high"), (b"BZh", "bzip2", "bz2", "high"), (b"\xfd7zXZ\x00", "xz", "xz", "high"),
    (b"7z\xbc\xaf'\x1c", "7z", "7z", "high"), (b"Rar!\x1a\x07\x00", "rar", "rar", "high"), (b"Rar!\x1a\x07\x01\x00", "rar", "rar", "high"), (b"MSCF", "cab", "cab", "high"),
    (b"SQLite format 3\x00", "sqlite", "sqlite", "high"), (b"\x7fELF", "elf", "elf", "high"), (b"\x00asm", "wasm", "wasm", "high"), (b"fLaC", "flac", "flac", "high"),
    (b"OggS", "ogg", "ogg", "high"), (b"BM", "bmp", "bmp", "high"), (b"{\\rtf", "rtf", "rtf", "high"), (b"%!PS-", "postscript", "ps", "high"),
    (b"\xed\xab\xee\xdb", "rpm", "rpm", "high"), (b"!<arch>\n", "ar", "ar", "high"), (b"QFI\xfb", "qcow2", "qcow2", "high"), (b"KDMV", "vmdk", "vmdk", "medium"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole_cf", "ole", "medium"),
]
# Markers within a ZIP container, first match wins; the office kinds need two more.
ZIP_MARKERS = [
    ("odt", "application/vnd.oasis.opendocument.text"), ("ods", "application/vnd.oasis.opendocument.spreadsheet"), ("odp", "application/vnd.oasis.opendocument.presentation"),
    ("epub", "application/epub+zip"), ("jar", "META-INF/MANIFEST.MF"), ("apk", "AndroidManifest.xml"),
]
OFFICE = [("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/")]
# Prefixes of structured formats: prefix, kind, confidence.
PREFIXES = [
    (b"\xff\xf1", "aac", "high"), (b"\xff\xf9", "aac", "high"), (b"\x00\x00\x01\xba", "mpeg_ps", "medium"), (b"\x00\x00\x01\xb3", "mpeg_ps", "medium"), (b"II*\x00", "tiff", "high"), (b"MM\x00*", "tiff", "high"),
    (b"ID3", "mp3", "medium"), (b"\xfe\xed\xfa\xce", "mach_o", "high"), (b"\xfe\xed\xfa\xcf", "mach_o", "high"), (b"\xce\xfa\xed\xfe", "mach_o", "high"), (b"\xcf\xfa\xed\xfe", "mach_o", "high"), (b"\xca\xfe\xba\xbe", "mach_o", "high"), (b"\xbe\xba\xfe\xca", "mach_o", "high"),
]
CLASS_ORDER = ["structured_text_like", "text_like", "binary_like", "unknown_mixed"]


def _starts(data: Column, prefix: bytes) -> Column:
    return F.substring(data, 1, len(prefix)) == F.lit(prefix)


def _at(data: Column, offset: int, text: str) -> Column:
    return F.substring(data, offset + 1, len(text)) == F.lit(text).cast("binary")


def _holds(data: Column, text: str) -> Column:
    return data.contains(F.lit(text.encode()))


def classify(data: Column, html_first: bool = False) -> Column:
    """struct(kind, confidence) of binary content: structure, then magic, then xml, html, json, text, else bin.

    Any text that begins with ``<`` and holds ``</`` is xml, so most html documents are;
    ``html_first`` tests html before xml.
    """
    is_ = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    rules: list[tuple[Column, Column]] = []
    for kind, name in (("wav", "WAVE"), ("avi", "AVI "), ("webp", "WEBP")):
        rules.append((_at(data, 0, "RIFF") & _at(data, 8, name), is_(kind, "high")))
    prefix = lambda want: [(_starts(data, h), is_(k, c)) for h, k, c in PREFIXES if k in want]
    rules += prefix(("aac", "mpeg_ps"))
    rules += [((F.octet_length(data) > 41000) & _at(data, 0x8001, "CD001"), is_("iso", "high")), ((F.octet_length(data) > 262) & _at(data, 257, "ustar"), is_("tar", "high"))]
    rules += prefix(("tiff",))
    rules.append((_starts(data, b"\x00\x00\x01\x00") & (F.octet_length(data) >= 8) & (F.hex(F.substring(data, 5, 1)) != "00"), is_("ico", "high")))
    rules += prefix(("mp3",))
    rules.append((_starts(data, b"\xff") & (F.octet_length(data) >= 2) & (F.conv(F.hex(F.substring(data, 2, 1)), 16, 10).cast("int") >= 0xE0), is_("mp3", "medium")))
    ebml = _starts(data, b"\x1aE\xdf\xa3")
    rules += [(ebml & _holds(data, "webm"), is_("webm", "medium")), (ebml, is_("mkv", "medium"))]
    byte = lambda k: F.conv(F.hex(F.substring(data, 0x3D + k, 1)), 16, 10).cast("int") * (256**k)
    at = byte(0) + byte(1) + byte(2)
    rules.append((_starts(data, b"MZ") & (F.octet_length(data) >= 0x40) & (F.substring(data, at + 1, F.lit(4)) == F.lit(b"PE\x00\x00")), is_("pe", "high")))
    rules += prefix(("mach_o",))
    pk = _starts(data, b"PK\x03\x04")
    both = _holds(data, "[Content_Types].xml") & _holds(data, "_rels/.rels")
    rules += [(pk & both & _holds(data, m), is_(k, "high")) for k, m in OFFICE] + [(pk & _holds(data, m), is_(k, "high")) for k, m in ZIP_MARKERS] + [(pk, is_("zip", "medium"))]
    rules += [(_starts(data, b"!<arch>\n") & _holds(data, "debian-bina"), is_("deb", "high")), (_holds(data, "MANIFEST-"), is_("leveldb", "medium"))]
    rules += [(_starts(data, h), is_(k, c)) for h, k, _, c in MAGIC]
    text = F.try_validate_utf8(data.cast("string"))
    trimmed = F.regexp_replace(text, r"^\s+", "")
    xml = trimmed.startswith("<?xml") | (trimmed.startswith("<") & trimmed.contains("</"))
    low = F.lower(text)
    html = low.contains("<html") | low.contains("<!doctype html")
    markup = [(F.coalesce(xml, F.lit(False)), is_("xml", "medium")), (F.coalesce(html, F.lit(False)), is_("html", "medium"))]
    rules += markup[::-1] if html_first else markup
    rules += [(is_json(text), is_("json", "high")), (printable(data) * 100 >= 90 * F.octet_length(data), is_("text", "medium"))]
    empty = F.octet_length(data) == 0
    body = reduce(lambda a, r: a.when(*r), rules[1:], F.when(*rules[0])).otherwise(is_("bin", "low"))
    return F.when(empty, is_("bin", "low")).otherwise(body)


# What the JSON reader allows beyond the standard, switched off, and its own bounds, lifted.
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxNestingDepth": str(2**31 - 1), "maxNumLen": str(2**31 - 1), "maxStringLen": str(2**31 - 1)}
#: Every escape in a JSON text but lone surrogates.
_ESCAPES = r"(?i)\\(?:[^u]|u(?!d[89a-f])[0-9a-f]{4}|ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2})"


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; never null.

    Spark's parsers stop after the first value and accept any text that begins with one, a number
    for instance. Here the text must do both as the only element of an array and as the only value
    of an object: what could follow a value in one of them is an error in the other. Strict, as the
    reference is: no NaN, no comma before a closing bracket, no lone surrogates.
    """
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _JSON)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", _JSON)
    lone = F.regexp_replace(text, _ESCAPES, "").contains("\\")
    return F.coalesce((F.size(element) == 1) & (F.size(member) == 1) & ~lone, F.lit(False))


# White space of JSON.
_SPACE = " \t\n\r"
#: Every valid escape of a JSON string; of surrogates only pairs.
_VALID_ESCAPES = r'\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})'


def is_loose_json(text: Column) -> Column:
    """Whether DuckDB's ``json_valid`` takes the text; never null.

    That is JSON, of any depth, that may hold NaN and Infinity (in any case, Infinity also as
    inf) and one comma before a closing bracket. The text is brought to strict JSON with its strings
    emptied, which keeps invalid texts invalid. It must then end where a value of an object and
    an element of an array end, as in `is_json`; it is skipped there, so no depth is too much.
    """
    bare = F.regexp_replace(F.regexp_replace(text, _VALID_ESCAPES, "x"), r'"[^"\\\x00-\x1F]*+"', '""')
    bare = F.regexp_replace(bare, r"(?i)-?(?:nan|inf(?:inity)?)", "null")
    # a comma right after an opening bracket stays, as an error
    bare = F.regexp_replace(bare, r"([\[{][ \t\n\r]*+,)|,(?=[ \t\n\r]*+[\]}])", "$1")
    ends = lambda before, after: F.from_json(F.concat(F.lit('{"v":' + before), bare, F.lit(after + ',"w":1}')), "w int", _JSON)["w"] == 1
    # most texts are no JSON by their first characters
    begins = F.substring(F.ltrim(text, F.lit(_SPACE)), 1, 5).rlike(r'^(?:[\[{"0-9-]|true|false|null|(?i:nan|inf))')
    return F.when(begins, F.coalesce(ends("", "") & ends("[", "]") & ~bare.contains("\\"), F.lit(False))).otherwise(F.lit(False))


def classify_text(text: Column, html_first: bool = False) -> Column:
    """struct(kind, confidence) of a text: the rules of `classify` less the signatures of binary formats, which words begin with too (BM, ID3).

    White space before markup is a space, tab or line end; JSON is loose.
    """
    is_ = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    trimmed, low = F.ltrim(text, F.lit(_SPACE)), F.lower(text)
    markup = [(trimmed.startswith("<?xml") | (trimmed.startswith("<") & text.contains("</")), is_("xml", "medium")), (low.contains("<html") | low.contains("<!doctype html"), is_("html", "medium"))]
    rules = [(text.contains("MANIFEST-"), is_("leveldb", "medium")), *(markup[::-1] if html_first else markup)]
    rules += [(is_loose_json(text), is_("json", "high")), (printable(text.cast("binary")) * 100 >= 90 * F.octet_length(text), is_("text", "medium"))]
    return reduce(lambda a, r: a.when(*r), rules, F.when(text == "", is_("bin", "low"))).otherwise(is_("bin", "low"))


def printable(data: Column) -> Column:
    """Bytes that are printable ASCII, line feed, carriage return or tab; bytes are read as Latin-1."""
    return F.length(F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\n\r\t\x20-\x7E]", ""))


def assigned_name(number: Column, kind: Column, confidence: Column) -> Column:
    """Deterministic names: the extension only at high confidence, a guess at medium, none at low; null without a number."""
    ext = F.create_map(*(x for k, e in {k: e for _, k, e, _ in MAGIC}.items() for x in (F.lit(k), F.lit(e))))
    stem = F.when(number.isNotNull(), F.format_string("file_%06d", number))
    return F.when(confidence == "high", F.concat(stem, F.lit("."), F.coalesce(F.try_element_at(ext, kind), kind))).when(confidence == "medium", F.concat(stem, F.lit(".probable-"), kind, F.lit(".bin"))).otherwise(F.concat(stem, F.lit(".bin")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def content_class(kind: Column, ext: Column, sample: Column, structured: list[str], textual: list[str]) -> Column:
    """By extension, then by zero bytes and the share of unprintable ones in the first 4 KiB."""
    head = F.substring(sample, 1, 4096)
    odd = 1.0 - printable(head) / F.octet_length(head)
    return F.when(kind != "file", "unknown_mixed").when(ext.isin(structured), "structured_text_like").when(ext.isin(textual), "text_like").when(F.octet_length(head) == 0, "unknown_mixed").when(head.contains(F.lit(b"\x00")), "binary_like").when(odd > 0.30, "binary_like").otherwise("text_like")


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "directory", 0).when(kind == "symlink", 1).when(kind == "file", 2).otherwise(99)


def ordering(strategy: str) -> list[Column]:
    """The ascending sort key of an ordering strategy over path, kind, size and ext."""
    rank, size, ext, path = kind_rank(F.col("kind")), F.col("size"), F.col("ext"), F.col("path")
    keys = {
        "lexical": [path],
        "size_ascending": [rank, size, ext, path],
        "size_descending": [rank, -size, ext, path],
        "extension_grouped": [rank, ext, path],
        "kind_then_extension": [rank, ext, size, path],
    }
    return keys[strategy]


def interleave(rows: DataFrame, bucket: str, *order: str) -> DataFrame:
    """Round-robin over buckets: the position within the bucket, then the bucket."""
    return ranges.place(rows, [bucket], [F.col(c) for c in order], "turn")


def sweep(runs: DataFrame, input_bytes: DataFrame) -> DataFrame:
    """Truncated averages per dataset and level, and the ratio to the input."""
    cut = lambda c: F.floor(F.sum(c) / F.count("*")).cast("long").alias(c)
    out = runs.groupBy("dataset", "zstd_level").agg(cut("archive_size_bytes"), cut("pack_time_ms"), cut("extract_time_ms"))
    return out.join(input_bytes, "dataset").withColumn("ratio", F.when(F.col("total_bytes") > 0, F.col("archive_size_bytes") / F.col("total_bytes")).otherwise(0.0))


def human_size(n: Column) -> Column:
    """Binary units with one decimal from KiB on."""
    unit = lambda k, name: F.format_string("%.1f " + name, F.floor(n * 10 / 1024**k) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KiB")).when(n < 1024**3, unit(2, "MiB")).otherwise(unit(3, "GiB"))
