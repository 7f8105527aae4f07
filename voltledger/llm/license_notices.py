"""Public notices by SPDX name (operator 8's default table).

A notice holds the words that name its licence or that only its licence has. " ... " stands for words that
differ from text to text, such as numbers of clauses and names of holders. BSD is the family, for texts
that do not go on to tell which.
"""

from __future__ import annotations

_GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
    "Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU_ONLY = (
    "you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the "
    "Free Software Foundation"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met"
)
_BSD_CLAUSES = (
    _BSD + ": ... Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. ... Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution."
)
_ENDORSE = "used to endorse or promote products derived from this software without specific prior written permission."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted"
)


def _gnu(name: str, *versions: str) -> tuple[str, ...]:
    return tuple(header.format(name, version) for version in versions for header in (_GNU, _GNU_ONLY))


def _cc(short: str, long: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {short} 4.0.",
        f"Creative Commons {long} 4.0 International License",
    )


_TEXTS = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT,
        _MIT + ", and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ),
    "MIT-0": (
        _MIT + ", and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("General Public License", "3"),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        *_gnu("General Public License", "2"),
    ),
    "LGPL-3.0": (
        "licensed under the GNU Lesser General Public License, version 3.",
        *_gnu("Lesser General Public License", "3"),
    ),
    "LGPL-2.1": (
        "licensed under the GNU Lesser General Public License, version 2.1.",
        *_gnu("Lesser General Public License", "2.1"),
    ),
    "LGPL-2.0": (
        "licensed under the GNU Library General Public License, version 2.",
        *_gnu("Library General Public License", "2"),
    ),
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License, version 3.",
        *_gnu("Affero General Public License", "3"),
    ),
    "GFDL-1.2": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU "
        "Free Documentation License, Version 1.2",
    ),
    "GFDL-1.3": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU "
        "Free Documentation License, Version 1.3",
    ),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": (
        "CC0 1.0 Universal Public Domain Dedication",
        "has waived all copyright and related or neighboring rights to",
    ),
    "BSD": (_BSD,),
    "BSD-2-Clause": (_BSD_CLAUSES + " THIS SOFTWARE IS PROVIDED BY",),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be " + _ENDORSE,
        "nor the names of its contributors may be " + _ENDORSE,
        "The name of the author may not be " + _ENDORSE,
        _BSD_CLAUSES + " ... nor the names of its contributors may be " + _ENDORSE,
        _BSD_CLAUSES + " ... The name of the author may not be " + _ENDORSE,
    ),
    "BSD-4-Clause": (
        _BSD_CLAUSES + " ... All advertising materials mentioning features or use of this software must "
        "display the following acknowledgement: This product includes software developed by ... nor the "
        "names of its contributors may be " + _ENDORSE,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "EPL-1.0": (
        "are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    "EPL-2.0": (
        "are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
    ),
    "ISC": (
        _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0BSD": (_ISC + ". THE SOFTWARE IS PROVIDED \"AS IS\"",),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _named(*names: str, versions: tuple[str, ...]) -> tuple[str, ...]:
    """A name with its version as people write it."""
    forms = ("{} {}", "{} version {}", "{} v{}", "{} v. {}")
    return tuple(form.format(name, version) for name in names for version in versions for form in forms)


def _gnu_named(long: str, short: str, *versions: str) -> tuple[str, ...]:
    joined = tuple(f"{gnu}{short}v{version}" for gnu in ("GNU ", "") for version in versions)
    return (*_named(f"GNU {long}", f"GNU {short}", short, versions=versions), *joined)


# What a licence is called where a text says that it is under it.
_NAMES = {
    "Apache-2.0": (
        *_named("Apache License", "Apache Software License", versions=("2.0", "2")),
        "Apache 2.0 License",
        "Apache-2.0 License",
    ),
    "MIT": ("MIT License",),
    "GPL-3.0": _gnu_named("General Public License", "GPL", "3", "3.0"),
    "GPL-2.0": _gnu_named("General Public License", "GPL", "2", "2.0"),
    "LGPL-3.0": _gnu_named("Lesser General Public License", "LGPL", "3", "3.0"),
    "LGPL-2.1": _gnu_named("Lesser General Public License", "LGPL", "2.1"),
    "AGPL-3.0": _gnu_named("Affero General Public License", "AGPL", "3", "3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "MPL-2.0": _named("Mozilla Public License", "MPL", versions=("2.0",)),
    "EPL-1.0": _named("Eclipse Public License", versions=("1.0",)),
    "EPL-2.0": _named("Eclipse Public License", versions=("2.0",)),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": _named("Boost Software License", versions=("1.0",)),
}


def _mentions(names: tuple[str, ...]) -> tuple[str, ...]:
    """Five words or more that say that something is under a licence of one of these names."""
    found = []
    for name in names:
        found.append(f"the terms of the {name}")
        if len(name.split()) > 2:
            found.append(f"under the {name}")
            continue
        lead = "" if len(name.split()) == 2 else "is "
        found += [f"{lead}{verb} under the {name}" for verb in ("licensed", "released", "distributed", "available")]
    return tuple(found)


NOTICES = {license: (*texts, *_mentions(_NAMES.get(license, ()))) for license, texts in _TEXTS.items()}
