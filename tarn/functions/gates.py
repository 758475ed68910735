"""Gates and small functions of the scan as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments and extensions of each class, and the class's bit.
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "fixture", "fixtures", "__fixtures__")
VENDOR_SEGMENTS = ("vendor", "third_party", "third-party", "thirdparty", "deps", "external", "extern", "node_modules")
GENERATED_SEGMENTS = ("generated", "gen", "autogen", "auto", "build", "dist", "out", "target", "bazel-bin", "bazel-out", "buck-out")
SOURCE_EXTENSIONS = tuple("rs c h cc cpp hpp m mm go java kt swift py js jsx ts tsx rb php cs fs scala clj groovy dart lua sh bash zsh ps1 toml yaml yml json xml html htm css scss less md txt cfg ini conf sql proto gradle".split())
BINARY_EXTENSIONS = tuple("png jpg jpeg gif bmp ico tiff webp zip gz tgz xz bz2 7z rar tar zst pdf doc docx ppt pptx xls xlsx mp3 wav flac ogg mp4 mov avi mkv woff woff2 ttf otf exe dll so dylib bin dat db sqlite class jar war wasm".split())
SOURCE, TEST, VENDOR, GENERATED, BINARY, UNKNOWN = 1, 2, 4, 8, 16, 32


def latin1(content: Column) -> Column:
    """Bytes as text in which a character is a byte."""
    return F.decode(content.cast("binary"), "ISO-8859-1")


def entropy(text: Column) -> Column:
    """Shannon bits a character, without a shuffle."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)).cast("double"))
    n = F.size(chars).cast("double")
    return F.when(F.size(chars) > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c)) / n).otherwise(F.lit(0.0))


def secret(text: Column, pattern: str, group: int | None = None) -> Column:
    """The configured group, or the first, or the match; the first that isn't empty."""
    tries = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in dict.fromkeys(x for x in (group, 1, 0) if x is not None)]
    return F.coalesce(*tries)


def quoted(text: Column, at: Column, size: Column) -> Column:
    """Whether the same quote stands on both sides of a secret (at counts from 1); edges of the text pass."""
    left, right = F.substring(text, at - 1, F.lit(1)), F.substring(text, at + size, F.lit(1))
    return (at <= 1) | (at + size > F.length(text)) | ((left == right) & left.isin('"', "'", "`"))


def assignment_shape(text: Column) -> Column:
    return text.rlike(r"^[^=:>]*[=:>][ \t\"'`=>]*[A-Za-z0-9_.-]{10,}")


def likely_binary(text: Column, first: int = 8192) -> Column:
    return F.instr(F.substring(text, 1, first), "\0") > 0


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment; a dot at its beginning is none."""
    return F.regexp_extract(F.lower(path), r"[^/]\.([^./]*)$", 1)


def path_class(path: Column) -> Column:
    segments, ext = F.split(F.lower(path), "/"), extension(path)
    has = lambda names, bit: F.when(F.arrays_overlap(segments, F.lit(list(names))), bit).otherwise(0)
    bits = has(TEST_SEGMENTS, TEST) + has(VENDOR_SEGMENTS, VENDOR) + has(GENERATED_SEGMENTS, GENERATED)
    bits = bits + F.when(ext.isin(*SOURCE_EXTENSIONS), SOURCE).otherwise(0) + F.when(ext.isin(*BINARY_EXTENSIONS), BINARY).otherwise(0)
    return F.when(bits == 0, UNKNOWN).otherwise(bits).cast("int")


def excluded(path: Column, version: int) -> Column:
    """Only versions from 2 on exclude paths: those of binary extensions."""
    return extension(path).isin(*BINARY_EXTENSIONS) if version >= 2 else F.lit(False)


def archive_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.(tar\.gz|tgz)$"), "targz").when(F.endswith(low, F.lit(".tar")), "tar").when(F.endswith(low, F.lit(".gz")), "gzip").when(F.endswith(low, F.lit(".zip")), "zip")
