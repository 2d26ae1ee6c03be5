"""Fill-in-the-middle rearrangement of texts, with cuts located on a wavelet matrix.

Every byte of a slice of texts gets a character class; a wavelet matrix over the classes answers how many of a class lie
in front of a byte. The boundaries of a unit are one class or several: code points begin at any byte that continues none,
words at their first byte, lines after a newline. The number of units of a text is a difference of such counts. A cut
after k units is found by ``select`` where one class marks the boundary and by bisection on summed ranks otherwise, for
all texts of a slice at once.

The place of both cuts and the form come from a hash of the id and a seed, so they don't depend on how rows are dealt.
Nothing is shuffled; a task holds one slice of about 1 MB, or one longer text, and about four bits more for each byte.

Defined results: a null text counts as empty; an empty text, and one that contains a marker, stays plain; a null id is
hashed as an empty one; repeated rows with one id are cut alike, and rows with different ids on their own; an empty table
gives an empty table; extra columns pass through, those called like a new column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.wavelet import WaveletMatrix
from touchline.llm.words import slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CONTINUE, INNER, MARK, START, BLANK, NEWLINE = range(6)
LEVELS = 3
#: Classes that make a boundary, and whether the boundary lies behind the byte.
UNITS = {"char": ((INNER, MARK, START, BLANK, NEWLINE), False), "word": ((START,), False), "line": ((NEWLINE,), True)}
COLUMNS = ("fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_output")

_KIND = np.full(256, INNER, dtype=np.uint8)
_KIND[:128] = [INNER if chr(b).isalnum() else MARK for b in range(128)]
_KIND[0x80:0xC0] = CONTINUE
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[0x0A] = NEWLINE


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The character class of every byte of consecutive texts."""
    kinds = _KIND[data]
    blank = kinds >= BLANK
    first = np.empty_like(blank)
    first[:1], first[1:] = True, blank[:-1]
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    kinds[first & ~blank] = START
    return kinds


class Units:
    """Units of consecutive texts, counted and located on a wavelet matrix."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "char"):
        self.kinds, self.behind = UNITS[unit]
        self.start, self.end = offsets[:-1], offsets[1:]
        self.matrix = WaveletMatrix(classes(data, offsets), LEVELS)
        self.before = self.matrix.ranks(self.kinds, self.start)
        self.marks = self.matrix.ranks(self.kinds, self.end) - self.before
        self.count = self.marks
        if self.behind:  # a last line without a newline is a line
            filled = self.end > self.start
            last = np.zeros(len(offsets) - 1, dtype=bool)
            last[filled] = data[self.end[filled] - 1] != 0x0A
            self.count = self.marks + last
        elif unit != "char":  # a text of blanks is one unit
            self.count = np.maximum(self.marks, self.end > self.start)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The byte behind the first ``k`` units of each text."""
        inside = (k > 0) & (k < self.count)
        nth = self.before + np.where(inside, k, 0) - (1 if self.behind else 0)
        out = np.where(k > 0, self.end, self.start)
        if len(self.kinds) == 1:
            out[inside] = self.matrix.select(self.kinds[0], nth[inside]) + self.behind
        else:
            out[inside] = self.matrix.bisect(self.kinds, self.start[inside], self.end[inside], nth[inside] + 1) - 1
        return out


def fill_in_middle(
    docs: DataFrame, unit: str = "char", text: str = "text", id_: str = "doc_id", seed: str = "1",
    plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """Add the number of units, the form (plain, psm or spm), the units of prefix and middle, and the output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256)
    numbers = [f"_fim_{k}" for k in range(1, 5)]
    kept = docs.drop(*COLUMNS, *numbers)
    drawn = kept.withColumns({
        name: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k, name in enumerate(numbers)
    })
    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in zip(COLUMNS, types, strict=True))])
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    names = kept.columns

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            draws = [batch.column(c).to_numpy() for c in numbers]
            own = batch.select(names)
            for first, last in slices(offsets):
                at = offsets[first : last + 1]
                new = _rearranged(data[at[0] : at[-1]], at - at[0], [d[first:last] for d in draws])
                yield pa.RecordBatch.from_arrays([*own.slice(first, last - first).columns, *new], [*names, *COLUMNS])

    def _rearranged(data, offsets, draws):
        units = Units(data, offsets, unit)
        n, raw = units.count, data.tobytes()
        one, two = draws[0] % (n + 1), draws[1] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        bounds = zip(offsets[:-1].tolist(), units.cut(low).tolist(), units.cut(high).tolist(), offsets[1:].tolist(), strict=True)
        spm = (draws[3] % 100 < spm_percent).tolist()
        plain = ((n == 0) | (draws[2] % 100 >= 100 - plain_percent)).tolist()
        p, s, m = markers
        forms, outputs = [], []
        for k, (a, b, c, d) in enumerate(bounds):
            whole = raw[a:d]
            if plain[k] or any(x in whole for x in markers):
                forms.append("plain")
                outputs.append(whole)
            elif spm[k]:
                forms.append("spm")
                outputs.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        none = np.array([f == "plain" for f in forms], dtype=bool)
        return [
            pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=none),
            pa.array(high - low, pa.int64(), mask=none), pa.array(outputs, pa.binary()).cast(pa.string()),
        ]

    return drawn.mapInArrow(run, schema)


def restore(form: str = "fim_form", output: str = "fim_output"):
    """Column: the text before rearranging. Markers can't arise where parts meet, so they split the output exactly."""
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
