"""Name-based identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of document ids, the one for domain names.
NAMESPACE = uuid.NAMESPACE_DNS


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version-5 identifier of a name: the first 16 bytes of the SHA-1 of namespace and UTF-8 name, with the version in bits 48 to 51 and the variant
    in 64 and 65. Null for a null name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name.cast("string"), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def document_id(doc_id: Column, place: Column) -> Column:
    """The stored id of a document: of its id, or of its place in the batch where it has none; an id that is a UUID already stays as it is."""
    text = F.coalesce(doc_id.cast("string"), place.cast("string"))
    is_uuid = text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(is_uuid, text).otherwise(uuid5(text))
