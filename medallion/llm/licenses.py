"""Licence scan by sentence rules.

A text is cut into sentences; each is normalised to lower-case words and mapped to the identifier of a known
licence sentence, with its version if it names one.  Grants (``licensed under ...``), which may name
several licences, fields (``License: MIT``) and SPDX lines may stand anywhere in a sentence of any length; each licence named
gives its identifier, unless the grant is denied.  A document's identifiers in order are then matched against
ordered rules: the first rule whose sequence stands in them names a licence and uses them up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, text_of

# Sentences of public licences as normalised words (patterns over whole sentences; a group is the version).
_GPL_FREE = (
    r"(?:this \w+|\w+) is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by "
    r"the free software foundation either version (\d+(?: \d+)?) of the license or at your option any later version")
_GPL_SEE = r"see the gnu {}general public license for more details"
_GPL_RECEIVED = r"you should have received a copy of the gnu {}general public license along with (?:this \w+|\w+)(?: if not .*)?"
KNOWN_SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache-copy", r"you may obtain a copy of the license at(?: https? www apache org licenses license 2 0)?"),
    ("apache-warranty", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-limits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-free", _GPL_FREE.format("")),
    ("lgpl-free", _GPL_FREE.format("(?:lesser|library) ")),
    ("agpl-free", _GPL_FREE.format("affero ")),
    ("gpl-hope", r"(?:this \w+|\w+) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", _GPL_SEE.format("")),
    ("lgpl-see", _GPL_SEE.format("(?:lesser|library) ")),
    ("agpl-see", _GPL_SEE.format("affero ")),
    ("gpl-received", _GPL_RECEIVED.format("")),
    ("lgpl-received", _GPL_RECEIVED.format("(?:lesser|library) ")),
    ("agpl-received", _GPL_RECEIVED.format("affero ")),
    ("mit-permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-permission", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", r"(?:\d )?neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("cc0", r"(?:.* )?cc0(?: \d \d)?(?: universal)?(?: public domain dedication)?"),
    ("zlib-origin", r"(?:\d )?the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("reserved", r"(?:copyright .* )?all rights reserved"),
)

# Titles, each a line or two of its own.
_TITLES: tuple[tuple[str, str], ...] = (
    ("gpl-title", r"(?:the )?gnu general public licen[sc]e version (\d)(?: \d)?(?: (?:\d+ )?june \d{4})?"),
    ("lgpl-title", r"(?:the )?gnu (?:lesser|library) general public licen[sc]e version (\d(?: 1)?)(?: (?:\d+ )?(?:june|february) \d{4})?"),
    ("agpl-title", r"(?:the )?gnu affero general public licen[sc]e version (\d)(?: \d+ november \d{4})?"),
    ("apache-title", r"apache licen[sc]e version (\d \d)(?: january 2004)?(?: https? www apache org licenses.*)?"),
    ("mpl-title", r"mozilla public licen[sc]e version (\d \d)"),
    ("epl-title", r"eclipse public licen[sc]e(?: version| v) ?(\d \d)"),
    ("bsl-title", r"boost software licen[sc]e version (\d \d)(?: august 17th 2003)?"),
    ("eupl-title", r"european union public licen[sc]e(?: version| v)? ?(\d \d)(?: eupl.*)?"),
    ("artistic-title", r"the artistic licen[sc]e (\d \d)"),
    ("zlib-title", r"(?:the )?zlib licen[sc]e"),
    ("isc-title", r"(?:the )?isc licen[sc]e(?: isc)?"),
    ("mit-title", r"(?:the )?mit licen[sc]e(?: mit)?"),
    ("bsd-title", r"(?:the )?bsd (\d) clause licen[sc]e"),
)

# A grant: its head, then names of licences one after another.
_HEAD = re.compile(
    r"\b(?:(?:licen[sc]ed|released|distributed|available|published|provided|covered|used)(?: \w+)? under(?: either)?(?: (?:the )?(?:terms|conditions) of)?"
    r"|under the terms of|this source code form is subject to(?: (?:the )?terms of)?) (?:either )?(?:of )?(?:(?:the|an?) )?")
_CC = r"(?:creative commons attribution|cc by)"
#: Names in order, the longer ones first; ``True`` if a version may follow.
NAMES: tuple[tuple[str, str, bool], ...] = (
    ("lgpl-grant", r"(?:gnu )?(?:(?:lesser|library) (?:general public licen[sc]e|gpl)|lgpl)", True),
    ("agpl-grant", r"(?:gnu )?(?:affero (?:general public licen[sc]e|gpl)|agpl)", True),
    ("gpl-grant", r"(?:gnu )?(?:general public licen[sc]e|gpl)", True),
    ("apache-grant", r"apache(?: software)?(?: licen[sc]e)?", True),
    ("mit-grant", r"(?:mit|expat)", False),
    ("bsd-grant:3", r"(?:(?:new|modified|revised) bsd|(?:\w+ )?3 clause bsd|bsd 3 clause)", False),
    ("bsd-grant:2", r"(?:simplified bsd|(?:\w+ )?2 clause bsd|bsd 2 clause)", False),
    ("bsd-grant:4", r"(?:original bsd|(?:\w+ )?4 clause bsd|bsd 4 clause)", False),
    ("bsd-grant:0", r"(?:0bsd|zero clause bsd|bsd 0 clause|bsd zero clause)", False),
    ("bsd-plain", r"bsd", False),
    ("mpl-grant", r"(?:mozilla public licen[sc]e|mpl)", True),
    ("epl-grant", r"(?:eclipse public licen[sc]e|epl)", True),
    ("eupl-grant", r"(?:european union public licen[sc]e|eupl)", True),
    ("bsl-grant", r"boost(?: software)?(?: licen[sc]e)?", True),
    ("artistic-grant", r"artistic(?: licen[sc]e)?", True),
    ("zlib-grant", r"zlib(?: libpng)?", False),
    ("isc-grant", r"isc", False),
    ("unlicense", r"unlicense", False),
    ("cc0", r"(?:creative commons )?(?:cc0|zero)(?: \d \d)?", False),
    ("cc-by-nc-sa", rf"{_CC} (?:noncommercial|non commercial|nc) (?:sharealike|share alike|sa)", True),
    ("cc-by-nc-nd", rf"{_CC} (?:noncommercial|non commercial|nc) (?:noderivatives|noderivs|no derivatives|nd)", True),
    ("cc-by-nc", rf"{_CC} (?:noncommercial|non commercial|nc)", True),
    ("cc-by-sa", rf"{_CC} (?:sharealike|share alike|sa)", True),
    ("cc-by-nd", rf"{_CC} (?:noderivatives|noderivs|no derivatives|nd)", True),
    ("cc-by", _CC, True),
)
# Words that mean much else: alone they name a licence only before the word itself, a version or the sentence's end.
_AMBIGUOUS = {"apache-grant", "mit-grant", "bsd-plain", "bsl-grant", "artistic-grant", "zlib-grant", "isc-grant", "cc0"}
_VERSION = r"(?:(?: licen[sc]e)?(?: ?version| ?v)? ?(?P<version>\d+(?: \d)?)(?!\w))?"
_LATER = r"(?P<later> (?:of the licen[sc]e )?or (?:(?:at your option|\(?at your option\)?) )?(?:any )?(?:later|newer)(?: versions?)?)?"
_TAIL = r"(?: only)?(?: (?:international|unported|universal))?(?P<word> licen[sc]es?)?(?!\w)"
_BETWEEN = re.compile(r" (?:(?:and or|and|or|as well as)(?: at your option)? )?(?:either )?(?:(?:the|an?) )?")
# So few words before a grant may turn it into its contrary.
_NEGATION = re.compile(r"\b(?:not(?! only)|never|neither|nor|no longer|cannot|(?:is|are|was|were|be|ca|won|can)n? t)(?: \w+){0,3} $")
_FIELD = re.compile(r"\blicen[sc]es?[\"']?[ \t]*[:=][ \t]*(\S[^\n]*)", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[\w.+-]+(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+[\w.+-]+)*)", re.I)
# The exception named after WITH is no licence.
_SPDX_NAME = re.compile(r"\bWITH[ \t(]+[\w.+-]+|\b(?:AND|OR)\b|([\w.+-]+)", re.I)

#: Rules in order: the licence (``{}``: the version the sequence names) and the identifiers one after another.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-{}", ("apache-grant", "apache-copy", "apache-warranty", "apache-limits")),
    ("GPL-{}-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-{}-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("LGPL-{}-or-later", ("lgpl-free", "gpl-hope", "lgpl-see", "lgpl-received")),
    ("LGPL-{}-or-later", ("lgpl-free", "gpl-hope", "lgpl-see")),
    ("AGPL-{}-or-later", ("agpl-free", "gpl-hope", "agpl-see", "agpl-received")),
    ("AGPL-{}-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("MIT", ("mit-permission", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-permission", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-permission", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-permission",)),
    ("Zlib", ("zlib-origin",)),
    ("MIT", ("mit-permission",)),
    ("GPL-{}-or-later", ("gpl-free",)),
    ("LGPL-{}-or-later", ("lgpl-free",)),
    ("AGPL-{}-or-later", ("agpl-free",)),
    ("{}", ("spdx",)),
    ("AGPL-{}", ("agpl-grant",)),
    ("LGPL-{}", ("lgpl-grant",)),
    ("GPL-{}", ("gpl-grant",)),
    ("Apache-{}", ("apache-grant",)),
    ("MIT", ("mit-grant",)),
    ("BSD-{}-Clause", ("bsd-grant",)),
    ("BSD", ("bsd-plain",)),
    ("MPL-{}", ("mpl-grant",)),
    ("EPL-{}", ("epl-grant",)),
    ("EUPL-{}", ("eupl-grant",)),
    ("BSL-{}", ("bsl-grant",)),
    ("Artistic-{}", ("artistic-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-{}", ("gpl-title",)),
    ("LGPL-{}", ("lgpl-title",)),
    ("AGPL-{}", ("agpl-title",)),
    ("Apache-{}", ("apache-title",)),
    ("MPL-{}", ("mpl-title",)),
    ("EPL-{}", ("epl-title",)),
    ("BSL-{}", ("bsl-title",)),
    ("EUPL-{}", ("eupl-title",)),
    ("Artistic-{}", ("artistic-title",)),
    ("Zlib", ("zlib-title",)),
    ("ISC", ("isc-title",)),
    ("MIT", ("mit-title",)),
    ("BSD-{}-Clause", ("bsd-title",)),
    ("Unlicense", ("unlicense",)),
    ("CC0", ("cc0",)),
    ("CC-BY-NC-SA-{}", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-{}", ("cc-by-nc-nd",)),
    ("CC-BY-NC-{}", ("cc-by-nc",)),
    ("CC-BY-SA-{}", ("cc-by-sa",)),
    ("CC-BY-ND-{}", ("cc-by-nd",)),
    ("CC-BY-{}", ("cc-by",)),
    ("all-rights-reserved", ("reserved",)),
)

# One of these stands in every known sentence.
_ANCHOR = re.compile(r"licen[sc]e|gpl|\bcc[ -]?(?:by|0)\b|creative commons|redistribut|permission|warrant|rights\s+reserved|public\s+domain|shall\s+the|must\s+not\s+be\s+misrepresented|under\s+the\s+terms|\b(?:released|distributed|available|published|provided|covered|used)(?:\s+\w+)?\s+under\b", re.I)
# Part of each anchor: most texts hold none and are done after plain searches.
_HINTS = ("licen", "gpl", "cc by", "cc-by", "ccby", "cc0", "cc 0", "cc-0", "creative", "redistribut", "permission", "warrant", "rights", "domain", "shall", "misrepresented", "under")
# A wrapped sentence begins with one of these where the line before has no full stop.
_BEGIN = re.compile(r"(?:\d )?(?:permission|redistribution|redistributions|neither|the above|the software|the origin of|this|unless|you|see|in no event|licen[sc]ed|released|(?:the )?gnu|apache|mozilla|eclipse|boost|european union) ")
_STOP = re.compile(r"(?<!\sv)[.!?]+(?=\s|$)")
_OTHER = re.compile(r"[^a-z0-9]+")
# ``2.0+`` means that version or a later one.
_PLUS = re.compile(r"(?<=\d)\+(?![\w+])")
#: Wrapped lines are joined up to so many words, more than a known sentence has; one line may have any number.
_LONGEST = 120


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", _PLUS.sub(" or later ", sentence.lower())).strip()


class Sentences:
    """Known sentences, looked up by their normalised words; what was seen before is kept in a bounded table."""

    def __init__(self, known: tuple[tuple[str, str], ...] = KNOWN_SENTENCES + _TITLES, names: tuple[tuple[str, str, bool], ...] = NAMES):
        self.known = [(name, re.compile(pattern)) for name, pattern in known]
        self.names = [(name, re.compile(pattern + (_VERSION + _LATER if versions else "") + _TAIL)) for name, pattern, versions in names]
        self.seen: dict[str, str | None] = {}

    def identify(self, sentence: str) -> str | None:
        """``name`` or ``name:version`` of a whole known sentence."""
        if sentence in self.seen:
            return self.seen[sentence]
        found = None
        if _ANCHOR.search(sentence):
            for name, pattern in self.known:
                m = pattern.fullmatch(sentence)
                if m:
                    version = m[1].replace(" ", ".") if pattern.groups and m[1] else ""
                    found = f"{name}:{version}" if version else name
                    break
        if len(sentence) < 2000:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[sentence] = found
        return found

    def list_of_names(self, sentence: str, at: int, starts: set[int]) -> tuple[list[tuple[int, str]], int]:
        """Place and identifier of the licences named one after another from ``at``, and the end of the last one.

        A version doesn't go on in another line (``starts``: the lines' places).
        """
        out: list[tuple[int, str]] = []
        end, sure, begin = at, False, at
        while found := next(((name, m) for name, pattern in self.names if (m := pattern.match(sentence, begin))), None):
            name, m = found
            parts = m.groupdict()
            end = m.end()
            version = ""
            if parts.get("version"):
                major, _, minor = m["version"].partition(" ")
                version = f"{major}.{minor}" if minor and m.end("version") - len(minor) not in starts else major
                if minor and version == major:
                    end = m.end("version") - len(minor) - 1
                if parts.get("later"):
                    version += "-or-later"
            sure = sure or bool(out) or name not in _AMBIGUOUS or bool(version) or "licen" in m[0]
            out.append((begin, f"{name}:{version}" if version else name))
            step = _BETWEEN.match(sentence, end)
            if not step:
                break
            begin = step.end()
        return (out, end) if sure or end == len(sentence) or end + 1 in starts else ([], at)

    def grants(self, sentence: str, starts: set[int]) -> list[tuple[int, str]]:
        """Place and identifier of each licence that a grant inside names, unless the grant is denied."""
        out: list[tuple[int, str]] = []
        if " under " in sentence or sentence.startswith("under ") or " subject to " in sentence:
            for head in _HEAD.finditer(sentence):
                names, _ = self.list_of_names(sentence, head.end(), starts)
                if names and not _NEGATION.search(sentence[max(0, head.start() - 60):head.start()]):
                    out += [(head.start() + i, name) for i, (_, name) in enumerate(names)]
        return out

    def field(self, raw: str) -> list[str]:
        """Licences of a line such as ``License: MIT``, which names nothing else."""
        m = _FIELD.search(raw)
        if not m or "spdx" in raw.lower():
            return []
        value = normalise(m[1])
        value = value.removeprefix("the ")
        names, end = self.list_of_names(value, 0, set())
        return [name for _, name in names] if end == len(value) else []

    def ids(self, text: str) -> list[str]:
        """Identifiers in page order.  Sentences end at a full stop before white space, at an empty line, or, if
        that gives a known sentence, at a line's end."""
        low = text.lower()
        if not any(hint in low for hint in _HINTS) or not _ANCHOR.search(text):
            return []
        found: list[str] = []
        for part in re.split(r"\n\s*\n", text):
            at = 0
            for stop in [*(m.end() for m in _STOP.finditer(part)), len(part)]:
                if stop > at and _ANCHOR.search(part, at, stop):
                    found += self._sentence(part[at:stop].split("\n"))
                at = stop
        return found

    def _sentence(self, raw: list[str]) -> list[str]:
        lines, places, out, end = [], [], [], 0
        for r in raw:
            if line := normalise(r):
                out += [(end, f"spdx:{n}") for m in _SPDX.finditer(r) for x in _SPDX_NAME.findall(m[1]) if (n := x.strip(".-"))]
                out += [(end, n) for n in self.field(r)]
                lines.append(line)
                places.append(end)
                end += len(line) + 1
        whole: list[tuple[int, int, str]] = []
        i = 0
        while i < len(lines):
            taken = 0
            if i == 0 or _BEGIN.match(lines[i] + " "):
                words, joined = 0, []
                for j in range(i, len(lines)):
                    joined.append(lines[j])
                    words += lines[j].count(" ") + 1
                    if words > _LONGEST and j > i:
                        break
                    if name := self.identify(" ".join(joined)):
                        best, taken = name, j - i + 1
            elif name := self.identify(lines[i]):
                best, taken = name, 1
            if taken:
                whole.append((places[i], places[i] + sum(len(x) + 1 for x in lines[i:i + taken]), best))
            i += taken or 1
        out += [(start, name) for start, _, name in whole]
        # A whole sentence may be a grant itself or hold one; it counts once.  That of CC0 begins with anything.
        out += [(at, name) for at, name in self.grants(" ".join(lines), set(places)) if not any(s <= at < e and (n == name or n != "cc0") for s, e, n in whole)]
        return [name for _, name in sorted(out, key=lambda x: x[0])]


def match_rules(ids: list[str], rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> list[str]:
    """Licences of a sequence of identifiers, in the rules' order; each identifier serves one rule."""
    names = [x.partition(":")[0] for x in ids]
    used, out = [False] * len(ids), []
    for licence, sequence in rules:
        n = len(sequence)
        for i in range(len(ids) - n + 1):
            if tuple(names[i:i + n]) == sequence and not any(used[i:i + n]):
                used[i:i + n] = [True] * n
                version = next((x.partition(":")[2] for x in ids[i:i + n] if ":" in x), "")
                out.append(licence.format(version) if version else licence.replace("-{}", ""))
    return out


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``c0``, ``c1``, ... (those of ``keep``), ``sentence_ids`` in order and ``licenses`` (distinct, sorted).

    Null and empty texts have none.  Every row, repeated ones too, is scanned as a whole, in time linear in a text but for
    wrapped lines, which are joined up to a fixed number of words.  An empty table gives no rows.  Columns may have any name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences()
        kind = pa.list_(pa.string())
        for batch in batches:
            for own in groups(batch, "text"):
                ids = [sentences.ids(t) for t in own.column("text").to_pylist()]
                licenses = [sorted(set(match_rules(x))) if x else [] for x in ids]
                fields = [own.schema.field(i) for i in range(own.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array(ids, kind), pa.array(licenses, kind)],
                    schema=pa.schema([*fields, ("sentence_ids", kind), ("licenses", kind)]))

    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), text_of(df, text).alias("text"))
    kept = [f"c{i} {narrow.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return narrow.mapInArrow(run, ", ".join([*kept, "sentence_ids array<string>, licenses array<string>"]))
