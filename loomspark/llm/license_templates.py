"""Templates of licence scans: notices, headers, titles, SPDX tags and the texts that grant a licence."""

NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"
_NEITHER = " {}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HPND = "Permission to use, copy, modify, {} this software and its documentation for any purpose {}, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

#: Texts that grant the licence themselves; BSD-2-Clause comes before the notice that both BSD licences share, and PSF-2.0 before HPND, which Python's own file quotes.
TWO_CLAUSES = [("BSD-2-Clause", _BSD.format(*a) + _AS_IS) for a in (("1. ", "2. "), ("", ""))]
TEXTS = [
    *[("BSD-3-Clause", (_BSD + _NEITHER).format(*a)) for a in (("1. ", "2. ", "3. "), ("", "", ""))],
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", _ISC),
    ("ISC", _ISC.replace("and/or", "and")),
    ("PSF-2.0", "This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software (Python) in source or binary form and its associated documentation."),
    ("HPND", _HPND.format("and distribute", "and without fee is hereby granted")),
    ("HPND", _HPND.format("distribute, and sell", "is hereby granted without fee")),
    ("Artistic-1.0", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package"),
    ("Artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

_GNU = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-1.0", _GNU.format("This program", ";", "General Public License", ";", "1")),
    ("GPL-2.0", _GNU.format("This program", ";", "General Public License", ";", "2")),
    ("GPL-3.0", _GNU.format("This program", ":", "General Public License", ",", "3")),
    ("LGPL-2.0", _GNU.format("This library", ";", "Library General Public License", ";", "2")),
    ("LGPL-2.1", _GNU.format("This library", ";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", _GNU.format("This library", ";", "Lesser General Public License", ";", "3")),
    ("AGPL-3.0", _GNU.format("This program", ":", "Affero General Public License", ",", "3")),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Distributed under the terms of the MIT License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]

#: What names a licence only if it is a whole line: in running text it can be said of anything.
SPDX = "Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 HPND ISC MIT MPL-1.1 MPL-2.0 PSF-2.0 Unlicense".split()
SPDX_GNU = [(f"{kind}-{v}", f"{kind}-{v}{end}") for kind, v in (("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"), ("GFDL", "1.1"), ("GFDL", "1.2"), ("GFDL", "1.3")) for end in ("", "-only", "-or-later")]
TITLES = [
    *[(name, f"SPDX-License-Identifier: {tag}") for name, tag in [*((s, s) for s in SPDX), *SPDX_GNU]],
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("PSF-2.0", "Python Software Foundation License Version 2"),
    ("Artistic-1.0", "The Artistic License"),
    ("Artistic-2.0", "The Artistic License 2.0"),
]

#: Words that tell licences apart, whatever the wording: a unit must hold those of the template, and of MODIFIERS no others.
MODIFIERS = "lesser affero noncommercial sharealike noderivatives by-nc by-sa by-nd by-nc-sa by-nc-nd attribution-noncommercial attribution-sharealike attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives".split()
FAMILIES = "apache artistic mozilla python mit bsd isc cc0 2-clause 3-clause".split()

TEMPLATES = [*TWO_CLAUSES, *NOTICES, *TEXTS, *HEADERS, *TITLES]
