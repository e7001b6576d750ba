import re
import textwrap

import duckdb

from pagechron.llm.license_scan import CUES, RULES, SENTENCES, scan_licenses, scan_sql

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
TEXTS = {
    1: "Prose.\nReleased under the MIT License.\nMore.",
    2: MIT,
    3: "Licensed under CC BY-NC 4.0.",
    4: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    5: "Licensed under the Moon License.",
    6: None,
    7: "",
    8: "Released under the MIT License. Licensed under the Apache License, Version 2.0. Released under the MIT License.",
    9: "All Rights  Reserved.",
    10: "Released under\nthe MIT License\nand more prose",
    11: "# Licensed under the\n# Moon License\nLicensed under the MIT License",
}


def scanned(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "doc_id long, text string, ids string")
    return {r.doc_id: r for r in scan_licenses(docs).collect()}


def test_rules(spark):
    got = scanned(spark)
    assert {k: r.licenses for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "CC-BY-NC-4.0", 4: "GPL-3.0-or-later", 5: "", 6: "", 7: "", 8: "MIT Apache-2.0", 9: "proprietary", 10: "", 11: "MIT"}
    assert got[2].sentence_ids == "mit-grant mit-notice"
    assert got[5].unknown_sentences == 1
    assert got[8].n_sentences == 3


NOTICES = {
    "MIT": MIT,
    "GPL-3.0-or-later": TEXTS[4].replace("Foundation; either", "Foundation, either"),
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


BSD_END = '\n\nTHIS SOFTWARE IS PROVIDED BY FOO CORP AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
MORE = [
    ("BSD-3-Clause", "Copyright 2020 Foo Corp. All rights reserved.\n\n" + NOTICES["BSD-2-Clause"] + "\n\n3. Neither the name of Foo Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + BSD_END),
    ("BSD-2-Clause", "Copyright 2020 Foo Corp.\nAll rights reserved.\n\n" + NOTICES["BSD-2-Clause"] + BSD_END),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT Apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("MIT", "This file is licensed under the MIT License."),
    ("MIT", "The source code is released under the terms of the MIT license."),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("proprietary", "(c) Foo Corp. All rights reserved."),
    ("", "Licensed under the Moon License."),
]


def test_names_tags_and_heads(spark):
    """Free places, tags, heads of whole licences; DataFrame and SQL alike."""
    rows = [(f"{k}|{leader}|{name}", wrapped(text, leader) if leader else text) for k, (name, text) in enumerate(MORE) for leader in ("", "# ", " * ")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: k.split("|")[2] for k, _ in rows}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(db.execute(scan_sql()).fetchall())


def wrapped(text, leader, width=72):
    return "\n".join(f"{leader}{line}".rstrip() for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


def test_wrapped_notices(spark):
    """As they are shipped: hard-wrapped, bare or in comments; DataFrame and SQL alike."""
    rows = [(f"{name}|{leader}", wrapped(text, leader)) for name, text in NOTICES.items() for leader in ("", "# ", " * ", "// ", "-- ")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: k.split("|")[0] for k, _ in rows}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(db.execute(scan_sql()).fetchall())


def test_equals_sql(spark):
    got = scanned(spark)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(TEXTS.items()))
    assert sorted(map(tuple, got.values())) == sorted(db.execute(scan_sql()).fetchall())


def test_tables_are_sound():
    assert all(re.search(CUES, s) for s in SENTENCES)
    assert {i for _, ids in RULES for i in ids} <= set(SENTENCES.values())


def test_odd_rows(odd_docs):
    assert scan_licenses(odd_docs).count() == 9
    assert scan_licenses(odd_docs.limit(0)).collect() == []
