"""License sentences that hold none of the words the SQL twin looks for, and every known sentence."""

import pytest

from gaugeflow.llm import licenses

NO_KEYWORD = {
    "Released under the GPL v2.": "GPL-2-ONLY", "Available under CC BY 4.0.": "CC-BY-4.0",
    "Distributed under the LGPL 2.1 or later.": "LGPL-2.1-OR-LATER", "Released under CC0.": "CC0-1.0",
    "Released under the AGPL v3.": "AGPL-3-ONLY", "Available under CC-BY-SA 3.0.": "CC-BY-SA-3.0",
    "Published under Creative Commons Attribution 4.0.": "CC-BY-4.0",
    "Provided under Creative Commons Zero.": "CC0-1.0",
}
ONE_EACH = {
    "Spdx=mit": ["SPDX-License-Identifier: MIT"],
    "ApacheRef2": ["Licensed under the Apache License, Version 2.0.", "Released under Apache Software License v2."],
    "ApacheExcept": ["You may not use this file except in compliance with the License."],
    "ApacheObtain": ["You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software"],
    "MitRef": ["Released under the MIT License.", "Available under the X11 license."],
    "MitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MitNotice": ["The above copyright notice and this permission notice (x) shall be included in all copies."],
    "MitAsIs": ["The software is provided as is, without warranty of any kind"],
    "MitLiability": ["In no event shall the authors be liable for any claim", "In no event shall the X Consortium be liable for any claim"],
    "BsdRef3": ["Released under the 3-clause BSD license."],
    "BsdIntro": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice"],
    "BsdBinary": ["Redistribution in binary form must reproduce the above copyright notice"],
    "BsdAdvert": ["All advertising materials mentioning features or use of this software must"],
    "BsdEndorse": ["Neither the name of X may be used to endorse or promote products"],
    "BsdAsIs": ["This software is provided by X as is"],
    "BsdLiability": ["In no event shall X be liable for any direct, indirect, incidental"],
    "IscRef": ["Licensed under the ISC license."],
    "IscGrant": ["Permission to use, copy, modify, and distribute this software for any purpose"],
    "IscAsIs": ["The software is provided as is and the author disclaims all warranties"],
    "LgplLater2.1": ["LGPL 2.1 or later", "GNU Library General Public License 2.1 or later"],
    "LgplRef3": ["Under the Lesser General Public Licence 3: covered under the LGPL 3"],
    "AgplLater3": ["AGPL 3 or later", "Affero General Public License 3 or later"],
    "AgplRef3": ["Covered by the AGPL 3", "Covered by the GNU Affero General Public License 3"],
    "GplLater2": ["GPL 2 or later", "General Public License 2 or later"],
    "GplRef2": ["Covered by the GPL 2", "Covered by the GNU General Public License 2"],
    "GnuNoWarranty": ["This file is distributed in the hope that it will be useful"],
    "GnuDetails": ["See the GNU General Public License for more details"],
    "GnuReceived": ["You should have received a copy of the GNU General Public License"],
    "MplRef": ["Subject to the terms of the Mozilla Public License", "Released under Mozilla Public License"],
    "MplObtain": ["If a copy of the MPL was not distributed with this file, you can"],
    "EplRef": ["Released under the Eclipse Public License"],
    "CcRef=by": ["Licensed under CC BY", "Licensed under CC-attribution", "Licensed under Creative Commons by"],
    "Cc0Ref": ["Placed here, released under CC0", "Released under Creative Commons Zero"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "PublicDomain": ["Text dedicated to the public domain", "It was placed in the public domain"],
    "BoostRef": ["Released under the Boost Software License"],
    "ZlibAsIs": ["This software is provided as-is, without any express or implied warranty"],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose"],
    "Wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies"],
    "Copyright": ["Copyright X 2020", "All rights reserved"],
    "Unknown": ["It is licensed under own terms", "Licensed to all", "License: own"],
}


def test_sentences_without_the_twins_keywords(frame):
    df = frame([(t,) for t in NO_KEYWORD], "text string")
    assert {r.text: r.license.licenses for r in licenses.scan(df).collect()} == NO_KEYWORD


def test_every_sentence_gets_its_identifier(frame):
    """Also of a text that holds nothing else, so no hint is missing."""
    want = {t: f"{name};" for name, texts in ONE_EACH.items() for t in texts}
    assert len(ONE_EACH) == len(licenses.SENTENCES)
    found = licenses.scan(frame([(t,) for t in want], "text string")).collect()
    assert {r.text: r.license.sentence_ids for r in found} == want


LGPL = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 *
 * You should have received a copy of the GNU Lesser General Public
 * License along with this library; if not, write to the Free Software
 * Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
 */"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES."""
WRAPPED = {
    LGPL: ("LgplLater2.1;GnuNoWarranty;GnuDetails;GnuReceived;", "LGPL-2.1-OR-LATER"),
    MPL: ("MplRef;MplObtain;", "MPL-2.0"),
    MIT: ("MitGrant;MitNotice;MitAsIs;MitLiability;", "MIT"),
    BSD: ("BsdIntro;BsdSource;BsdBinary;BsdEndorse;BsdAsIs;BsdLiability;", "BSD-3-CLAUSE"),
    # lines that are sentences of their own stay so
    "Copyright 2020 X\nLicensed under the MIT License\nAll rights reserved": (
        "Copyright;MitRef;Copyright;", "MIT"),
    "LGPL v2.1\nGPL v2 or later": ("GplLater2;", "GPL-2-OR-LATER"),
    "Some Title\nPermission is hereby granted, free of charge, to any person\nObtaining a copy of "
    "this software": ("MitGrant;", "MIT"),
    "GPL 2\n" + "Line Without End\n" * 20_000: ("", ""),
}


def test_wrapped_headers(frame):
    found = licenses.scan(frame([(t,) for t in WRAPPED], "text string")).collect()
    assert {r.text: (r.license.sentence_ids, r.license.licenses) for r in found} == WRAPPED
    assert all(r.license.n_unmatched == 0 for r in found)
