"""What texts say to state their licence: short headers, titles and tags, and the whole texts."""

from __future__ import annotations

import re
from pathlib import Path

WHOLE = Path(__file__).parent / "licence_texts"
#: Name in words, identifier, versions with the date of the title; no version stands for any of them.
GNU = [
    ("GNU General Public License", "GPL", "program", [("1", "February 1989", "1.0"), ("2", "June 1991", "2.0"), ("3", "29 June 2007", "3.0")]),
    ("GNU Lesser General Public License", "LGPL", "library", [("2.1", "February 1999", "2.1"), ("3", "29 June 2007", "3.0")]),
    ("GNU Library General Public License", "LGPL", "library", [("2", "June 1991", "2.0")]),
    ("GNU Affero General Public License", "AGPL", "program", [("3", "19 November 2007", "3.0")]),
]
UNVERSIONED = {"GPL": "GPL-1.0-or-later", "LGPL": "LGPL-2.0-or-later", "AGPL": "AGPL-1.0-or-later"}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NAMES = [
    ("Apache License", "Apache-2.0"), ("MIT License", "MIT"), ("ISC License", "ISC"), ("Mozilla Public License", "MPL-2.0"), ("BSD 2-Clause License", "BSD-2-Clause"), ("BSD 3-Clause License", "BSD-3-Clause"),
    ("Mozilla Public License, Version 1.1", "MPL-1.1"), ("Mozilla Public License, Version 2.0", "MPL-2.0"), ("Apache License, Version 2.0", "Apache-2.0"),
]


def short_templates() -> list[tuple[str, str]]:
    """(identifier, text) of one sentence, title or tag each."""
    out = [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
        ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
        ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
        ("CC0-1.0", "CC0 1.0 Universal"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("MIT", "The MIT License (MIT)"),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the software without restriction."),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ]
    for name, license_ in NAMES:
        out += [(license_, text) for text in (name, f"Licensed under the {name}.", f"Released under the {name}.")]
    for name, short, thing, versions in GNU:
        either = f"you can redistribute it and/or modify it under the terms of the {name}"
        for number, date, full in versions:
            stated = f"{short}-{full}"
            out += [(stated, text) for text in (
                f"{name} Version {number}, {date}", f"{name} Version {number}", f"This work is licensed under the {name}, version {number}.", f"This {thing} is free software: {either}, version {number}.",
                f"This {thing} is free software: {either} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version.", f"Licensed under {short} version {number}.", f"{short}v{number}",
            )]
        out += [(UNVERSIONED[short], text) for text in (name, f"This work is licensed under the {name}.", f"This {thing} is free software: {either} as published by the Free Software Foundation.")]
    for short, name in CC.items():
        for version in ("2.0", "2.5", "3.0", "4.0"):
            port = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            out += [(f"CC-{short}-{version}", text) for text in (f"Licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {name} {version} {port} License.", f"{name} {version} {port}")]
    for license_ in sorted({x for x, _ in out} | {"BSD-2-Clause", "Zlib", "BSL-1.0", "0BSD", "EPL-2.0"}):
        out.append((license_, f"SPDX-License-Identifier: {license_}"))
        if re.match("[AL]?GPL-.*[0-9]$", license_):
            out += [(license_, f"SPDX-License-Identifier: {license_}-{x}") for x in ("only", "or-later")]
    return list(dict.fromkeys(out))


def whole_texts() -> list[tuple[str, str]]:
    """(identifier, text) of whole licences. BSD-2, AGPL and the other CC 4.0 texts are made from their nearest relatives."""
    out = {p.stem: p.read_text() for p in sorted(WHOLE.glob("*.txt"))}
    bsd = out["BSD-3-Clause"].replace("REGENTS", "COPYRIGHT HOLDERS").replace("University", "copyright holder")
    out |= {"BSD-3-Clause": bsd, "BSD-2-Clause": re.sub(r"3\. Neither.*?permission\.\n", "", bsd, flags=re.S)}
    remote = (
        "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer "
        "all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the "
        "Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.\n\n"
    )
    gpl = re.sub(r"13\. Use with.*?(?=14\. Revised)", lambda _: remote, out["GPL-3.0"], flags=re.S)
    out["AGPL-3.0"] = re.sub(r"GNU\s+General\s+Public\s+License", "GNU Affero General Public License", gpl, flags=re.I).replace("29 June 2007", "19 November 2007")
    share = out["CC-BY-SA-4.0"]
    plain = "\n\n".join(p for p in re.split(r"\n\s*\n", share) if not re.search(r"Adapter's License|BY-SA Compatible", p) and not re.search(r"b\. ShareAlike\.", p))
    plain = re.sub(r"Attribution and ShareAlike", "Attribution", re.sub(r"Attribution-ShareAlike", "Attribution", plain))
    gain = " NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation. for NonCommercial purposes only" + " NonCommercial" * 4
    for short, name in CC.items():
        text = share if "SA" in short else plain
        title = text.replace("Attribution-ShareAlike", name) if "SA" in short else text.replace("Attribution 4.0", f"{name} 4.0")
        out[f"CC-{short}-4.0"] = title + gain * ("NC" in short) + " NoDerivatives produce and reproduce, but not Share, Adapted Material. You do not have permission under this Public License to Share Adapted Material." * ("ND" in short)
    return sorted(out.items())
