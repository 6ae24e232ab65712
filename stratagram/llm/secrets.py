"""Secret scan by dictionary-primed zstandard novelty.

Candidates are all long unbroken strings in reach of a word that speaks of
secrets.  For each, the marginal compressed bytes are measured: the surrounding text is
compressed with the candidate and with random characters in its place, both primed with a
dictionary of code words and identifiers.  What the dictionary and the surroundings can't
predict, an incompressible string, is reported as kind ``novel``, wherever it
occurs in the text; its other copies count as blank surroundings.  Three fixed
patterns (kinds assign, access, hex) are always reported; their novelty is
measured too.

Null text counts as empty; empty texts have no spans.  Very long texts are
scanned whole.  Repeated rows are kept.  An empty table gives no rows.  Other
columns pass by unread.
"""

from __future__ import annotations

import bisect
import itertools
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import documents_only, table

# The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARACTERS, ACCESS_CHARACTERS, HEX_CHARACTERS = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

#: A word that makes its surroundings sensitive, and what may stand between it and a candidate.
SENSITIVE = re.compile(r"(?:passw(?:or)?d|passphrase|secret|token|api[ _-]?key|credential|private[ _-]?key|access[ _-]?key|auth(?:orization)?|bearer|signature)", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
REACH = 48
#: What joins two candidates to one secret: segments of a token, lines of a block.
JOINT = re.compile(r"\.?(?:\r?\n[ \t]*)?")
#: Code points of text on either side that prime the measure.
SURROUNDINGS = 256
#: Longer candidates are measured piece by piece.
MEASURED = 1024
#: A candidate is incompressible if it adds this many bytes a character or more, where random letters and digits add one.
NOVEL = 0.7

#: Words of identifiers; the dictionary has them in lower case, capitalised (joined) and in upper case.
IDENTIFIERS = """
access account action address admin api application array async auth author authorization backup base batch bearer
bucket buffer build cache certificate change channel check class client cloud code common config configuration
connection content context control create credential current custom data database date debug default delete
description device directory document domain download enable encode endpoint environment error event example export
field file format frame function gateway generate group handler hash header height host identifier import index
information input internal item key label length level line list local location login member memory message method
mode model module name network number object option order output package page parameter parent password path payload
payment permission phone port private process product production profile project property protected provider proxy
public query queue read record reference register remote repository request reset resource response result return
role route schema search secret section secure select server service session setting size source state status string
support system table target task template test text time timeout title token transaction transfer type unique unit
user util value variable verification version view
""".split()
CODE = """
import export from class def function return self this public private protected static final const let var int long
float double string boolean null true false none new try catch except finally throw raise if else elif for while do
switch case break continue default with as in is not and or lambda yield async await package module interface enum
json yaml xml http https www com org net html charset utf-8 host=localhost username=user hostname= url= path=
example_token your_password_here changeme placeholder xxxxxxxxxxxxxxxxxxxxxxxx 0123456789abcdef 00000000000000000000
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ================ ---------------- ________________
"""
DICTIONARY = " ".join([*IDENTIFIERS, "".join(map(str.capitalize, IDENTIFIERS)), *map(str.upper, IDENTIFIERS), CODE]).encode()

_ANY = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-])|AKIA[A-Z0-9]|[0-9a-f]{24}|(?i:passw(or)?d|passphrase|secret|token|api[ _-]?key|credential|private[ _-]?key|access[ _-]?key|auth|bearer|signature)(?s:.{0,64})[A-Za-z0-9+/_=-]{16}"""


#: What can't be compressed, to measure candidates by.
_RANDOM = "".join(np.random.default_rng(99).choice(list(string.ascii_letters + string.digits), 4096)).encode()


class Novelty:
    """Marginal compressed bytes, primed with a dictionary."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 12):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def marginal(self, before: bytes, candidate: bytes, after: bytes) -> int:
        """The candidate's bytes less what they save beside as many random ones, so that the format's changes of mode cancel out."""
        around, n = before + b"\n" + after + b"\n", len(candidate)
        random = (_RANDOM * (n // len(_RANDOM) + 1))[:n]
        return n + len(self.compress(around + candidate)) - len(self.compress(around + random))

    def measure(self, text: str, a: int, b: int) -> int:
        """The marginal bytes of text[a:b] in its surroundings, where its other copies are blank."""
        if b - a > MEASURED:
            return sum(self.measure(text, k, min(b, k + MEASURED)) for k in range(a, b, MEASURED))
        own, n = text[a:b], b - a
        # A copy that the surroundings cut is blank too.
        before = text[max(0, a - SURROUNDINGS - n) : a].replace(own, " " * n)[-SURROUNDINGS:]
        after = text[b : b + SURROUNDINGS + n].replace(own, " " * n)[:SURROUNDINGS]
        return self.marginal(before.encode(), own.encode(), after.encode())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns."""
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARACTERS]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARACTERS]
    # A run of hex digits is as long as it can be, so only runs that are long enough are looked for.
    spans += [(*m.span(), "hex") for m in HEX_LONG.finditer(text)]
    return spans


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Incompressible strings in sensitive surroundings that overlap no span of ``taken``.

    Every candidate that starts within reach of a word is measured, on any line.  A candidate's own characters and
    what joins the next one to it don't count as reach, nor does what lies between a word and a candidate measured already.
    """
    out, at, m, held = [], 0, CANDIDATE.search(text), _Held(taken)
    for word in SENSITIVE.finditer(text):
        at = max(at, word.end())
        limit = at + REACH
        while m:
            if m.start() < at:
                m = CANDIDATE.search(text, at)
                continue
            if m.start() > limit:
                break
            a, b = m.span()
            limit += JOINT.match(text, b).end() - a
            at = b
            if held.overlaps(a, b):
                continue
            if novelty.measure(text, a, b) >= NOVEL * (b - a):
                out.append((a, b, "novel"))
    return _everywhere(text, taken, out)


class _Held:
    """Spans that are taken, for overlaps in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        held = sorted((a, b) for a, b, _ in spans)
        self.begins, self.reach = [a for a, _ in held], list(itertools.accumulate((b for _, b in held), max))

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.begins, b)
        return k > 0 and self.reach[k - 1] > a


def _everywhere(text: str, taken: list[tuple[int, int, str]], novel: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``novel`` and every other occurrence of its strings that overlaps none of ``taken`` and ``novel``: leftmost first, the longest of those, none overlapping."""
    if not novel:
        return novel
    import ahocorasick

    strings = ahocorasick.Automaton()
    for s in {text[a:b] for a, b, _ in novel}:
        strings.add_word(s, len(s))
    strings.make_automaton()
    held, found, at = _Held(taken + novel), sorted((end + 1 - n, -n) for end, n in strings.iter(text)), 0
    out = list(novel)
    for a, n in found:
        if a >= at:
            at = a - n
            if not held.overlaps(a, at):
                out.append((a, at, "novel"))
    return out


def find_spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of KINDS."""
    spans = base_spans(text)
    spans += novel_spans(text, spans, novelty)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus secrets: (kind, start, end, novelty) in code points, novelty in bytes a character.

    A column of that name is replaced.
    """
    docs = docs.drop("secrets")
    columns = docs.columns
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            out: list = [[]] * batch.num_rows
            for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False)).to_pylist():
                text = texts[i].as_py()
                out[i] = [
                    {"kind": k, "start": a, "end": b, "novelty": novelty.measure(text, a, b) / (b - a)}
                    for a, b, k in find_spans(text, novelty)
                ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SPAN)], names=[*columns, "secrets"])

    return docs.mapInArrow(run, plain + ", secrets array<struct<kind:string,start:long,end:long,novelty:double>>")


def op5_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, overlapping ones together, replaced by its (first) kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document stays, its secrets replaced by their kind; n_chars follows.

    Null and empty texts stay as they are, repeated rows change alike, an empty table stays empty.
    """
    ship(spark)
    columns, schema = docs.columns, docs.schema

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            found = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False)).to_pylist()
            cols = dict(zip(names, batch.columns))
            changed = {i: redact(t, spans) for i in found if (spans := find_spans(t := texts[i].as_py(), novelty))}
            if changed:
                new = texts.to_pylist()
                for i, t in changed.items():
                    new[i] = t
                cols["text"] = pa.array(new, texts.type)
                if "n_chars" in cols:
                    n = cols["n_chars"].to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    cols["n_chars"] = pa.array(n, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)

    return docs.mapInArrow(run, schema)
