"""Licence statements that stand in no list of the scan, and lines with cues that state none."""

from __future__ import annotations

from tracelake.llm import license_scan

STATED = [
    ("MIT", "This project is released under the MIT License."), ("MIT", "The MIT License (MIT)"), ("MIT", "# SPDX-License-Identifier: MIT AND Beerware"),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"), ("Apache-2.0", "Distributed under the Apache License 2.0."),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only"), ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("BSD", "The BSD 3-Clause License"), ("BSD", "Licensed under the BSD 2-Clause license."), ("MPL-2.0", "/* SPDX-License-Identifier: MPL-2.0-no-copyleft-exception */"),
    ("unknown", "Common Development and Distribution License, Version 1.1"), ("unknown", "SPDX-License-Identifier: WTFPL"), ("unknown", "Licensed under the Q Public License 1.0."),
]
NOT_STATED = [
    "The pilot lost a license in June 1991.", "They signed the general treaty, version 2.", "The public library has a license for version 3 of the program.",
    "She showed her driving license and the apache helicopter left.", "The clause of 3 words was in the second version.", "The board will license the hall to the club under the old terms.",
]


def test_statements_of_no_list(spark):
    lists = {t for _, t in license_scan.TEMPLATES + license_scan.TITLES} | {*license_scan.OTHERS, *license_scan.CUES} | {f"SPDX-License-Identifier: {i}" for ids in license_scan.SPDX.values() for i in ids}
    assert not lists & {*(t for _, t in STATED), *NOT_STATED}
    around = "thandre ofor the inan reon was at"
    texts = [*STATED, *((None, t) for t in NOT_STATED)]
    rows = license_scan.license_scan(spark.createDataFrame([(k, f"{around}\n{t}\n{around}") for k, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    got = [(f, {r["family"] for r in rows if r["doc_id"] == k}, t) for k, (f, t) in enumerate(texts)]
    assert [g for g in got if g[1] != ({g[0]} if g[0] else set())] == []
