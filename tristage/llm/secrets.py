"""Secret scans by dictionary-primed zstandard novelty.

Three rules give the base spans: assignments of a credential, access keys, long hex strings. Beyond
them the method looks at every string without spaces that stands near a sensitive word, before or
behind it, from ``LEAST`` characters on and to its own end; strings that hold such a word are cut
there. Its novelty is the number of bytes that it adds to the compressed surrounding text, when the
compressor is primed with a dictionary of identifiers, common syllables and long words, over its
length. ``PROSE`` goes before the surrounding text, so that letters are entropy coded in short texts
too. Names, words and paths repeat what the context or the dictionary holds and cost little; random
strings cost nearly their entropy and are reported as ``novel``. Base spans always stay; of a candidate that overlaps one, what the base
spans leave uncovered is reported if the candidate is novel, or else if that part itself is.

Whole texts are scanned; offsets are code points, ends exclusive. Null text counts as empty and gives
no span.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tristage.llm.columns import slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(
    r"password|passwd|passphrase|secret|token|api[_ -]?key|credential|private[_ -]?key|authorization|bearer|auth[_-]?key",
    re.ASCII | re.IGNORECASE,
)
LEAST = 12  # characters of a candidate
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# A superset of all of them in one linear pass; texts without a hit have no span.
ANY = r"(?i)passw|passphrase|secret|token|api[_ -]?key|credential|private[_ -]?key|authoriz|bearer|auth[_-]?key|akia[a-z0-9]{16}|[0-9a-f]{24}"
REACH = 64  # characters between a candidate and the sensitive word at most
CONTEXT = 256  # surrounding text on either side
NOVEL = 0.62  # bytes a character; random hex costs about 0.5 to 0.6, random base64 about 0.75 to 0.85
# Identifiers and syllables that a name or a word is made of.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey api-key credential private_key authorization bearer "
    "auth_key access_key client_id client_secret session user username admin login default example test config "
    "settings environment getenv os.environ process.env return self this value string None null true false import "
    "from class function def public static void const let var new https://www. http:// .com .org .net .html .json "
    "/usr/local/bin/ /home/ path file name directory version release build index data table column request response "
    "header content-type application/json encoding utf-8 timestamp january february march april monday tuesday "
    "ation tion ing ment able ence ance ness ship ious ical ably ions ther here with that this have from they will "
    "get set put add remove delete create update find search load save read write open close start stop run call send "
    "receive check parse format print handle callback event listener handler manager service factory provider client "
    "server host port socket thread process worker queue stack list array map key item index count size length width "
    "height color image video audio text string number integer float double boolean object array function method "
    "module package library framework database query result error message warning exception status state property "
    "attribute element node parent child root leaf tree graph model view controller component template style script "
    "order product customer account address email phone number street city country code id type kind group category "
    "administration advertisement announcement anniversary appreciation approximately appropriate architecture "
    "arrangement association authentication automatically availability certificate championship characteristic "
    "circumstances combination comfortable commercial communication comparison competition comprehensive concentration "
    "configuration congratulations consequently consideration construction contribution conversation corresponding "
    "demonstration description destination determination development difference disappointed discrimination "
    "distribution documentation educational electronic encouragement entertainment environmental established "
    "examination experience experimental explanation extraordinary fundamental furthermore generation government "
    "headquarters identification implementation improvement independent individual industrial infrastructure "
    "initialization instruction international interpretation introduction investigation investment kindergarten "
    "knowledgeable legislation maintenance manufacturer mathematical measurement multiplication neighborhood "
    "nevertheless nonetheless notification observation occasionally opportunity organization participation partnership "
    "particularly performance permanently personality perspective photograph possibility preparation presentation "
    "professional psychological publication recognition recommendation refrigerator registration relationship "
    "representative requirements responsibility restaurant restrictions revolutionary satisfaction significant "
    "simultaneously sophisticated specification straightforward subsequently substantial successfully sufficiently "
    "technological temperature temporarily theoretical traditional transformation transportation understanding "
    "unfortunately universities "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 -------- ======== ........ ________"
)

PROSE = (
    "The quick way to find out what a word is worth is to see how much of it was said before; most of what people write "
    "is made of the same few letters, and a name or a path is no other. Der Weg ist nicht so weit, und wer ihn geht, "
    "kommt bald an das Ziel. El camino no es largo para quien lo conoce, et le reste du voyage se fait sans peine. "
    "Jump over lazy dogs, vex big fjords, quiz my jack box. "
)


@functools.lru_cache(maxsize=4)
def _compressor(identifiers: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_bytes(candidate: str, before: str, after: str, identifiers: str = IDENTIFIERS) -> int:
    """Compressed bytes that the candidate adds to the text around it."""
    pack = _compressor(identifiers).compress
    around = PROSE + before + "\n" + after + "\n"
    return len(pack((around + candidate).encode())) - len(pack(around.encode()))


def novelty(candidate: str, before: str, after: str, identifiers: str = IDENTIFIERS) -> float:
    """Marginal bytes a character; of the string as it is and of the words its case spells, the less."""
    spelt = " ".join(WORD.findall(candidate)).lower()
    return min(marginal_bytes(x, before, after, identifiers) for x in {candidate, spelt or candidate}) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the three rules, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # runs are maximal, so short ones just go
    return sorted(found)


def _candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the strings within ``REACH`` of a word of ``words`` on either side, cut at these words."""
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in CANDIDATE.finditer(text):
        at = m.start()
        inside = words[bisect.bisect_right(ends, m.start()) : bisect.bisect_left(starts, m.end())]
        for s, e in [*inside, (m.end(), m.end())]:
            if s - at >= LEAST:
                i = bisect.bisect_left(starts, s)  # words before it end in front of ``at``
                if (i and at - ends[i - 1] <= REACH) or (i < len(starts) and starts[i] - s <= REACH):
                    yield at, s
            at = max(at, e)


def _uncovered(start: int, end: int, base: list[tuple[int, int, int]], reach: list[int]) -> list[tuple[int, int]]:
    """The parts of start to end outside the base spans; ``reach`` is the running maximum of their ends."""
    out = []
    for s, _, e in itertools.islice(base, bisect.bisect_right(reach, start), None):
        if s >= end:
            break
        if s > start:
            out.append((start, s))
        start = max(start, e)
    return [*out, (start, end)] if start < end else out


def novel_spans(text: str, base: list[tuple[int, int, int]], novel: float = NOVEL) -> list[tuple[int, int, int]]:
    """Incompressible strings near a sensitive word, or what the base spans leave uncovered of them."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    reach = [*itertools.accumulate((e for _, _, e in base), max)]

    def is_novel(a: int, b: int) -> bool:
        return novelty(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]) >= novel

    out = []
    for whole in _candidates(text, words) if words else ():
        rest = _uncovered(*whole, base, reach)
        if rest and not is_novel(*whole):
            rest = [x for x in rest if x != whole and x[1] - x[0] >= LEAST and is_novel(*x)]
        out += [(a, 3, b) for a, b in rest]
    return out


def spans_of(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base))


SPAN = StructType([StructField("start", IntegerType()), StructField("kind", StringType()), StructField("end", IntegerType())])


def scan(df: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """``df`` with its secrets as array<struct<start, kind, end>>, by start and then kind as listed."""
    kept = [c for c in df.columns if c != spans_col]
    schema = StructType([*[df.schema[c] for c in kept], StructField(spans_col, ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 8 << 20):
                texts = pc.fill_null(batch.column(text_col), "")
                hits = pc.match_substring_regex(texts, ANY).to_pylist()
                spans = [
                    [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans_of(texts[i].as_py())] if hit else []
                    for i, hit in enumerate(hits)
                ]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(spans, arrow)], [*kept, spans_col])

    return df.mapInArrow(run, schema)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(scanned: DataFrame, spans_col: str = "secret_spans") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel)."""
    spans = F.col(spans_col)
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every reported span of its text replaced by ``mark``; overlapping spans become one."""
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 8 << 20):
                column = batch.column(text_col)
                hits = pc.fill_null(pc.match_substring_regex(column, ANY), False).to_pylist()
                if any(hits):
                    column = pa.array([masked(x.as_py(), mark) if hit else x.as_py() for x, hit in zip(column, hits)], column.type)
                yield pa.RecordBatch.from_arrays([column if n == text_col else batch.column(n) for n in names], names)

    return df.mapInArrow(run, schema)


def masked(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans_of(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
