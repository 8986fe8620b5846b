"""Licence families with the names and passages of their notices: what the licence classifier learns from and confirms by."""

from __future__ import annotations

# Names, SPDX identifiers and opening passages of licences, as they stand in public licence texts and headers.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL": ("GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU AGPL", "AGPL version 3", "AGPL v3", "AGPLv3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License", "Apache v2", "ASL 2.0"),
    "Artistic": ("Artistic License", "Artistic License 2.0", "Perl Artistic License", "Artistic-2.0", "same terms as Perl itself"),
    "BSD": ("BSD License", "BSD licence", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "New BSD", "Simplified BSD", "Modified BSD", "three-clause BSD", "two-clause BSD", "BSD-style license", "BSD-style"),
    "Boost": ("Boost Software License", "Boost Software License, Version 1.0", "Boost License", "BSL-1.0"),
    "CC-BY": ("Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0", "Creative Commons Attribution", "CC BY 4.0", "CC BY 3.0", "CC BY", "CC-BY", "CC-BY-4.0", "creativecommons.org/licenses/by"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial-ShareAlike", "Creative Commons Attribution-NonCommercial-NoDerivatives", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-4.0", "creativecommons.org/licenses/by-nc"),
    "CC-BY-ND": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs", "CC BY-ND 4.0", "CC BY-ND", "CC-BY-ND", "CC-BY-ND-4.0", "creativecommons.org/licenses/by-nd"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-Share Alike", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA", "CC-BY-SA", "CC-BY-SA-4.0", "creativecommons.org/licenses/by-sa"),
    "CC0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0", "Creative Commons Zero", "creativecommons.org/publicdomain/zero"),
    "EPL": ("Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0", "Eclipse Public License - v 2.0", "EPL 2.0", "EPL-2.0", "EPL v1.0"),
    "EUPL": ("European Union Public Licence", "European Union Public License", "EUPL 1.2", "EUPL-1.2", "EUPL v1.2", "EUPL"),
    "GPL": ("GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL version 2", "GPL version 3", "GPL v2", "GPL v3", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-or-later", "GPL license"),
    "ISC": ("ISC License", "ISC licence", "Internet Systems Consortium License"),
    "LGPL": ("GNU Lesser General Public License", "GNU Lesser General Public License version 3", "GNU Library General Public License", "GNU LGPL", "LGPL version 3", "LGPL v2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later"),
    "MIT": ("MIT License", "MIT licence", "MIT/X11 License", "Expat License", "MIT/Expat License", "MIT-style license"),
    "MPL": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 1.1", "MPL 2.0", "MPL-2.0", "MPL 1.1"),
    "OFL": ("SIL Open Font License", "SIL Open Font License, Version 1.1", "Open Font License", "OFL-1.1", "OFL 1.1"),
    "Unlicense": ("The Unlicense", "the Unlicense (unlicense.org)", "unlicense.org"),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib licence"),
    "proprietary": ("All rights reserved", "All Rights Reserved Worldwide", "confidential and proprietary", "proprietary and confidential"),
    "CDDL": ("Common Development and Distribution License", "Common Development and Distribution License 1.0", "CDDL 1.0", "CDDL-1.0", "CDDL"),
    "MS-PL": ("Microsoft Public License", "Microsoft Public License (Ms-PL)", "MS-PL", "Ms-PL license"),
    "OpenSSL": ("OpenSSL License", "OpenSSL licence", "OpenSSL and SSLeay licenses"),
    "PSF": ("Python Software Foundation License", "Python Software Foundation License Version 2", "PSF License", "PSF-2.0", "PSF license agreement"),
    "PostgreSQL": ("PostgreSQL License", "PostgreSQL licence", "The PostgreSQL License"),
    "WTFPL": ("WTFPL", "WTFPL version 2", "Do What The Fuck You Want To Public License"),
}
SPDX: dict[str, tuple[str, ...]] = {
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "Apache-2.0": ("Apache-2.0",), "Artistic": ("Artistic-2.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "Boost": ("BSL-1.0",), "CC-BY": ("CC-BY-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
    "CC-BY-ND": ("CC-BY-ND-4.0",), "CC-BY-SA": ("CC-BY-SA-4.0",), "CC0": ("CC0-1.0",), "EPL": ("EPL-2.0",), "EUPL": ("EUPL-1.2",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"), "ISC": ("ISC",),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"), "MIT": ("MIT",), "MPL": ("MPL-2.0",), "OFL": ("OFL-1.1",), "Unlicense": ("Unlicense",), "Zlib": ("Zlib",),
    "CDDL": ("CDDL-1.0", "CDDL-1.1"), "MS-PL": ("MS-PL",), "OpenSSL": ("OpenSSL",), "PSF": ("PSF-2.0", "Python-2.0"), "PostgreSQL": ("PostgreSQL",), "WTFPL": ("WTFPL",),
}
PASSAGES: dict[str, tuple[str, ...]] = {
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "See the GNU Affero General Public License for more details"),
    "Apache-2.0": ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    "Artistic": ("you can redistribute it and/or modify it under the same terms as Perl itself", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License"),
    "BSD": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    "Boost": ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC-BY-ND": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under CC0 1.0 Universal"),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",),
    "EUPL": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL",),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "See the GNU General Public License for more details", "You should have received a copy of the GNU General Public License along with this program"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "See the GNU Lesser General Public License for more details"),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",),
    "OFL": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced without prior written permission", "Unauthorized copying of this file, via any medium, is strictly prohibited", "No part of this document may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher"),
    "CDDL": ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License", "When distributing Covered Code, include this CDDL HEADER in each file"),
    "MS-PL": ("This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software", "This source is subject to the Microsoft Public License"),
    "OpenSSL": ("This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "The names OpenSSL Toolkit and OpenSSL Project must not be used to endorse or promote products derived from this software without prior written permission"),
    "PSF": ("This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software",),
    "PostgreSQL": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", "PostgreSQL is released under the PostgreSQL License, a liberal Open Source license"),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",),
}

FUNCTION_WORDS = "a all along also an and any are as at be been being by can do each either for from had has have he her his how if in into is it its may more must no not of on one or our out own shall she should so some such than that the their them then there these they this those to under unless up use used via was we were what when which who will with without you your".split()
VERBS = ("Licensed under the", "Released under", "Distributed under the terms of the", "Published under the", "is available under", "This work is licensed under a", "may be used under the terms of the", "covered by the", "see LICENSE for the", "License:")

# Text about licences, or with words of their names, that grants none; and text about other things.
OTHER: tuple[str, ...] = (
    "The driver showed a licence to the officer before the test", "A fishing license is required in this state for the lake", "The committee will issue a license to operate the station",
    "Poetic licence lets an author change the order of events", "Artistic licence in the film annoyed the historians", "The new version of the software was released on Monday", "The general public was free to visit the museum",
    "This work is under review by the board", "The public meeting was held under the terms of the agreement", "Version 2.0 of the report is available on the site", "Version 3 of the plan is published by the foundation",
    "Students at MIT met the press", "MIT and other schools published the study", "The Mozilla team met the press", "The Apache helicopter crew attended the show", "Apache is a people of the Southwest", "Free copies of the documentation were handed out",
    "The source of the river is in the mountains", "She asked permission to copy the file", "Permission to use the hall was granted by the council free of charge", "Redistribution of wealth was debated in parliament", "Redistribution of income and use of land", "The conditions of the contract were met",
    "The copyright office opens at nine", "Common land and creative work by the author", "Attribution of the painting is disputed", "It is and the of to in with for on at by", "The eclipse of the sun was public and free to watch", "The Eclipse editor starts slowly",
    "The European Union published a public report", "Members of the European Union met the commission", "A boost for the software business", "The boost lasted for a year", "The font is large and open", "An open door and a soft font", "The BSD operating system has a long history", "GNU is a project of the foundation",
    "The zlib library compresses files", "Compression with zlib is fast", "Creative people shared commons and parks", "The Creative Commons organisation was founded in 2001", "Zero creative output in the commons", "Rights of the workers were reserved for the second part", "All seats are reserved", "He reserved all rights to appeal",
    "No part of the bridge may be used without a permit", "The confidential report was leaked", "A proprietary blend of herbs", "Unauthorized entry is strictly prohibited", "Copying from other students is prohibited", "The file was copied to the new disk", "The library is open to the public on Sunday",
    "Drivers must renew the license within ten years", "The bar lost its liquor license", "Marriage licences are issued by the city", "The software license was too expensive for the school", "Ask the lawyer about the license before you sign", "License plates are changed every year", "Read the terms of the license with care", "The terms of use were published by the site",
    "Free software is a matter of liberty", "A copy of the letter was distributed to any person who asked", "The author waived the fee", "The law limits damages of any kind", "The software is provided to schools", "The program is free for children", "You can modify the recipe and use less salt", "The work is published by the press", "Copyright law protects the author for seventy years",
    "Lesser known works of the general", "The general gave the lesser task to the public servant", "Perl is a language itself", "The ISC met in May", "The internet systems of the consortium failed", "The international attribution of blame is hard", "He made a sharealike gesture", "Distributed systems are hard to test", "The terms and conditions apply to all users of the site",
    "The artistic license debate was long", "An artistic license let the director change the end", "Critics praised the artistic license of the film", "With artistic license he moved the castle", "She took some artistic license with the story",
    "The common development of the region and its distribution network", "Microsoft held a public event for the press", "The Microsoft store opened to the public", "The Python team of the foundation met in spring", "A python was seen in the software office", "The software foundation elected a new board",
    "The Apache Software Foundation elected its board", "Members of the Apache Software Foundation voted by mail", "The Foundation of the museum met under one or more agreements", "The OpenSSL project released a fix", "OpenSSL encrypts the connection", "PostgreSQL stores rows in tables", "The PostgreSQL server was restarted", "Neither the name of the ship nor the names of its crew are known", "The name of the holder was written on the card", "The contributors to the volume met the editor",
    "The contents of this box are subject to duty", "If you do not accept the offer, do not sign", "Everyone is permitted to enter the garden", "The agreement is between the city and the individual", "This product includes nuts", "The company sells licenses for its database", "A license agreement was signed by both sides",
)
