from __future__ import annotations

import itertools
import time

from medallion.llm import licenses as li
from medallion.llm.common import table

from .conftest import ODD

MIT = """Copyright 2020 someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. The rest"""

GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""

CASES = {
    MIT: (["mit-permission", "mit-notice", "mit-warranty"], ["MIT"]),
    "Licensed under the Apache License, Version 2.0.": (["apache-grant:2.0"], ["Apache-2.0"]),
    "no stop here\nThis work is licensed under the GNU General Public License, version 3.\nmore": (["gpl-grant:3"], ["GPL-3"]),
    "It is released under the MIT License. Released under the MIT license!": (["mit-grant", "mit-grant"], ["MIT"]),
    "Licensed under CC BY-NC 4.0.\nAll rights reserved.": (["cc-by-nc:4.0", "reserved"], ["CC-BY-NC-4.0", "all-rights-reserved"]),
    "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": (["cc-by-sa:4.0"], ["CC-BY-SA-4.0"]),
    "You need no license to read this permission slip.": ([], []),
}


def test_cases():
    sentences = li.Sentences()
    for text, (ids, names) in CASES.items():
        got = sentences.ids(text)
        assert got == ids and sorted(set(li.match_rules(got))) == sorted(names), text[:60]


def test_wrapped_sentence_with_semicolon_inside():
    # The colon and semicolon of the GPL's own sentences are no ends of sentences there.
    assert li.Sentences().ids(GPL)[0] == "gpl-free:3"
    assert li.match_rules(li.Sentences().ids(GPL)) == ["GPL-3-or-later"]


def test_rules_are_ordered_and_use_up_sentences():
    assert li.match_rules(["bsd-permission", "bsd-source", "bsd-binary", "bsd-names"]) == ["BSD-3-Clause"]
    assert li.match_rules(["bsd-permission", "bsd-source", "bsd-binary", "mit-grant"]) == ["BSD-2-Clause", "MIT"]
    assert li.match_rules(["apache-grant:2.0", "apache-grant:1.1"]) == ["Apache-2.0", "Apache-1.1"]
    assert li.match_rules(["bsd-source"]) == [] and li.match_rules([]) == []


HEADER = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}
General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your
option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {2} General Public License for more details.

You should have received a copy of the GNU {2} General Public License along with this {0}.  If not, see <x>."""

GRANTS = {
    "This project is licensed under the MIT License - see the LICENSE.md file for details": ["mit-grant"],
    "It was released under the MIT License and may be copied": ["mit-grant"],
    "Licensed under the Apache License, Version 2.0 as of 2020, by us": ["apache-grant:2.0"],
    "Published under the GPL v3, 2020, and so on": ["gpl-grant:3"],
    "Published under the GPL version 3\n5 files": ["gpl-grant:3"],
    "word " * 500 + "licensed under the MIT License.": ["mit-grant"],
    "word " * 500 + "licensed under the MIT\nLicense " + "word " * 500 + "and parts released under the GPL 2 " + "word " * 300: ["mit-grant", "gpl-grant:2"],
    "licensed under the mitigated license": [], "Licensed under CC0": ["cc0"], "Licensed under CC BY 4.0 or so\nAll rights reserved": ["cc-by:4.0", "reserved"],
    "# SPDX-License-Identifier: Apache-2.0\nimport x": ["spdx:Apache-2.0"],
    "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */": ["spdx:GPL-2.0-only", "spdx:MIT"],
}


def test_grants_inside_sentences_of_any_length():
    for text, ids in GRANTS.items():
        assert li.Sentences().ids(text) == ids, text[:80]
    assert li.match_rules(["spdx:GPL-2.0-only", "spdx:MIT"]) == ["GPL-2.0-only", "MIT"]


def test_lesser_and_affero_headers():
    for header, licence in ((HEADER.format("library", ";", "Lesser", "2.1"), "LGPL-2.1-or-later"), (HEADER.format("program", ":", "Affero", "3"), "AGPL-3-or-later")):
        ids = li.Sentences().ids(header)
        assert len(ids) == 4 and li.match_rules(ids) == [licence]


NAMED = {
    "released under the BSD 3-Clause License": ["BSD-3-Clause"], "dual-licensed under MIT or Apache-2.0": ["Apache-2.0", "MIT"],
    "You may use it under the terms of the MIT or Apache 2.0 licenses": ["Apache-2.0", "MIT"], "License: MIT": ["MIT"],
    'license = "BSD-2-Clause"': ["BSD-2-Clause"], "Eclipse Public License - v 2.0": ["EPL-2.0"],
    "Boost Software License, Version 1.0": ["BSL-1.0"], "Licensed under the EUPL-1.2": ["EUPL-1.2"],
    "European Union Public Licence v. 1.2": ["EUPL-1.2"], "The Artistic License 2.0": ["Artistic-2.0"],
    "        GNU GENERAL PUBLIC LICENSE\n           Version 3, 29 June 2007\n\nCopyright": ["GPL-3"],
    "Licensed under the GPL version 2 or later": ["GPL-2-or-later"], "Released under GPL-2.0+": ["GPL-2.0-or-later"],
    "Available under either the GNU LGPL v2.1 or later or the MPL 2.0.": ["LGPL-2.1-or-later", "MPL-2.0"],
    "Licensed under MIT, Apache-2.0 or the zlib license": ["Apache-2.0", "MIT", "Zlib"],
    "This is not licensed under the MIT license.": [], "It isn't released under the GPL": [], "It was never made available under the MPL 2.0": [],
    "not only licensed under the MIT License but free": ["MIT"], "published under the MIT press imprint": [], "used under a boost of power": [],
    "License: see the file": [], "licensed under the terms of our contract": [], "under the terms of the artistic director": [],
}


def test_names_lists_fields_and_titles():
    for text, names in NAMED.items():
        assert sorted(set(li.match_rules(li.Sentences().ids(text)))) == names, text


def test_every_list_of_names():
    """All lists of two and three names by all heads, against the names they were made of."""
    names = {"the MIT License": "MIT", "Apache-2.0": "Apache-2.0", "GPLv3": "GPL-3", "the LGPL 2.1 or later": "LGPL-2.1-or-later", "BSD-3-Clause": "BSD-3-Clause", "CC BY-SA 4.0": "CC-BY-SA-4.0"}
    heads = ("Licensed under", "This file is dual-licensed under either", "code is released under the terms of")
    sentences = li.Sentences()
    for head, between, n in itertools.product(heads, (" or ", " and "), (2, 3)):
        for chosen in itertools.permutations(names, n):
            text = f"{head} {', '.join(chosen[:-1])}{between}{chosen[-1]}, as you like."
            assert sorted(li.match_rules(sentences.ids(text))) == sorted(names[c] for c in chosen), text


LINES = {  # the licence lines of the given documents
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved",
}


def test_given_documents(llm, sf):
    for r in li.scan(table(llm, sf, "documents"), ["text"]).collect():
        found = [LINES[line] for line in (r["c0"] or "").split("\n") if line in LINES]
        assert len(r["sentence_ids"]) == len(found) and r["licenses"] == sorted(set(found))


def test_long_texts_in_linear_time():
    for unit in ("licensed under ", "under the terms of mit or ", "license: ", "licensed under mit or "):
        began = time.process_time()
        li.Sentences().ids(unit * 40_000)
        assert time.process_time() - began < 20


def test_odd_rows(odd, none):
    found = li.scan(odd, odd.columns).collect()
    assert len(found) == len(ODD) and not any(r["licenses"] for r in found)
    assert li.scan(none, ["doc_id"]).count() == 0
    assert li.Sentences().ids("license " * 50_000 + "\n" + "license\n" * 20_000) == []
