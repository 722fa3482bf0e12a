"""Licence notices as they stand in files, with what a reader would name; written without a look at the tables of sentences."""

import pytest

from colloquy.llm import licenses

NOTICES = {
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.\n\n"
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\nFITNESS."),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will\nthe authors be held liable for any damages arising from the use of this software.\n\n"
             "Permission is granted to anyone to use this software for any purpose, including commercial\napplications, and to alter it and redistribute it freely, subject to the following restrictions:\n"),
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in\nsource code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "LGPL-2.1-or-later": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Apache-2.0": "                              Apache License\n                        Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone may",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n",
    "BSD": "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n",
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\n\nIN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, "Some words first.\n\n" + t) for k, t in NOTICES.items()] + [("none", "We grant no license, and none is granted to anyone."), ("empty", "")], "name string, text string")
    return {r.name: (r.licences, r.licence_sentences) for r in licenses.licensed(docs).collect()}


def test_notices_name_their_licence_alone(found):
    assert {k: found[k][0] for k in NOTICES} == {k: [k] for k in NOTICES}
    assert all("unknown" not in found[k][1] for k in NOTICES if k != "Apache-2.0")
    assert found["none"][0] == found["empty"][0] == []


def test_sentences_that_name_no_licence_are_marked_alone(spark):
    """Each is all that its text has, wrapped and marked as a comment."""
    texts = {
        "LOSS OF USE, DATA, OR\n * PROFITS;": "bsdloss",
        "In no event will the authors be held\n * liable for any damages arising from the use of this software.": "zlibliable",
        "Anyone is\n * free to copy, modify, publish, use, compile, sell, or distribute this software, either in\n * source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any\n * means.": "unlicenseanyone",
        "If a copy of the\n * MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl2copy",
    }
    docs = spark.createDataFrame([(i, f"/*\n * {t}\n */") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence_sentences"] for r in licenses.licensed(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [[x] for x in texts.values()]
