"""Licence notices as they stand in files: wrapped, in comments, with list marks."""

from __future__ import annotations

import textwrap

from catalog_engine.llm import licences

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
NOTICES = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL3, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}
NOTICES |= {
    "GPL-2.0": GPL3.replace("software: you", "software; you").replace("version 3", "version 2"),
    "LGPL": GPL3.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "AGPL-3.0": GPL3.replace("GNU General", "GNU Affero General"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
SPDX = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0": "GPL-2.0", "LGPL-2.1-only": "LGPL", "BSD-3-Clause": "BSD-3-Clause", "MIT-0": None}


def test_wrapped_notices(spark):
    cases = []
    for name, notice in NOTICES.items():
        for width in (50, 70, 1000):
            parts = [textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in notice.split("\n\n")]
            plain = "\n\n".join(parts)
            cases += [(plain, [name]), ("/*\n" + "\n".join(f" * {line}" for line in plain.split("\n")) + "\n */\nint x;", [name]), ("Some words\n" + plain.replace("\n", "\r\n"), [name])]
    cases += [(f"{mark}SPDX-License-Identifier: {given}{end}\ncode", [name] if name else []) for given, name in SPDX.items() for mark, end in (("", ""), ("# ", ""), ("/* ", " */"))]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r["licences"] for r in licences.scan_licences(frame).collect()}
    wrong = [(t[:90], want, found[k]) for k, (t, want) in enumerate(cases) if found[k] != want]
    assert not wrong, wrong


ONE_LINE = {
    "This work is released under CC-BY-4.0.": ["CC-BY"],
    "This software is licensed under GPLv3.": ["GPL-3.0"],
    "This program is distributed under the GPL v3.": ["GPL-3.0"],
    "This program is licensed under GPL-2.0.": ["GPL-2.0"],
    "SPDX-License-Identifier: Apache-2.0 OR MIT": ["Apache-2.0", "MIT"],
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": ["MIT", "Apache-2.0", "BSD-3-Clause"],
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0"],
    "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note OR MIT": ["GPL-2.0", "MIT"],
    "It is available.\nAvailable under the MIT License and the Apache License 2.0.": ["MIT", "Apache-2.0"],
    "This project is dual licensed under either of the MIT\nor Apache-2.0 license.": ["MIT", "Apache-2.0"],
    "Licensed under the Eclipse Public License 2.0.": ["EPL"],
    "Released under the zlib license.": ["Zlib"],
    "Licensed under the Artistic License 2.0.": ["Artistic-2.0"],
    "SPDX-License-Identifier: EPL-2.0": ["EPL"],
    "Available under the counter and the MIT building.": [],
    "The MIT and the GNU project were under pressure.": [],
}


def test_glued_versions_expressions_and_two_licences(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(ONE_LINE)], "doc_id long, text string")
    found = {r["doc_id"]: r["licences"] for r in licences.scan_licences(frame).collect()}
    wrong = [(t, want, found[k]) for k, (t, want) in enumerate(ONE_LINE.items()) if found[k] != want]
    assert not wrong, wrong
