"""Licence texts that files are scanned for, as data: label, mandatory phrases, text.

Texts of one label are alternatives or parts of one licence; parts end where a name or year is
filled in.  Case and punctuation don't matter.
"""

from __future__ import annotations

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{1}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{2}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_FREE = (
    "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, "
    "or (at your option) any later version. "
)

#: The licences' own words.
TEXTS = [
    # Notices of one line.
    ("apache-2.0", ["apache license version 2 0"], "licensed under the apache license version 2 0"),
    ("mit", ["mit license"], "released under the mit license"),
    ("gpl-3.0", ["gnu general public license version 3"], "licensed under the gnu general public license version 3"),
    ("gpl-2.0", ["gnu general public license version 2"], "licensed under the gnu general public license version 2"),
    ("lgpl", ["gnu lesser general public license"], "under the terms of the gnu lesser general public license"),
    ("agpl", ["gnu affero general public license"], "under the terms of the gnu affero general public license"),
    ("cc-by-nc-4.0", ["cc by nc 4 0"], "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", ["cc by sa 4 0"], "licensed under cc by sa 4 0"),
    ("cc-by-4.0", ["cc by 4 0"], "licensed under cc by 4 0"),
    ("cc-by-4.0", ["creative commons attribution 4 0 international"], "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", ["creative commons attribution sharealike 4 0 international"], "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-1.0", ["cc0 1 0 universal"], "creative commons legal code cc0 1 0 universal"),
    ("bsd", ["bsd license"], "released under the bsd license"),
    ("mpl-2.0", ["mozilla public license"], "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", ["released into the public domain"], "this is free and unencumbered software released into the public domain"),
    # Whole texts and headers.
    (
        "mit-text",
        ["permission is hereby granted free of charge"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    (
        "mit-text",
        ["permission is hereby granted free of charge"],
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    (
        "isc",
        ["permission to use copy modify and or distribute this software"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',
    ),
    ("bsd", ["redistribution and use in source and binary forms"], _BSD.format("", "", "")),
    ("bsd", ["redistribution and use in source and binary forms"], _BSD.format("", "1. ", "2. ")),
    ("bsd", ["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "apache-2.0",
        ["licensed under the apache license version 2 0"],
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and '
        "limitations under the License.",
    ),
    ("gpl-2.0", ["gnu general public license", "either version 2 of the license"], _FREE.format("General Public License", "2")),
    ("gpl-3.0", ["gnu general public license", "either version 3 of the license"], _FREE.format("General Public License", "3")),
    ("lgpl", ["gnu lesser general public license"], _FREE.format("Lesser General Public License", "2.1")),
    ("lgpl", ["gnu lesser general public license"], _FREE.format("Lesser General Public License", "3")),
    ("agpl", ["gnu affero general public license"], _FREE.format("Affero General Public License", "3")),
    (
        "mpl-2.0",
        ["mozilla public license"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        ["released into the public domain"],
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        ["this software is provided as is without any express or implied warranty"],
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions:",
    ),
    (
        "bsl-1.0",
        ["boost software license"],
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
]
