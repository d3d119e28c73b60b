"""Letters and forms that read like plain ones, for parsers of typed values."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕАВЕКМНОРСТУХІοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ−–", "aeopcyxijsABEKMHOPCTYXIoABEZHIKMNOPTYX--")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")


def readable(text: str) -> str:
    """A text as a reader would type it: plain letters, figures and spaces."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", text)
    return unicodedata.normalize("NFKC", text.replace("²", "^2").replace("³", "^3")).translate(LOOKALIKES)
