"""Dimension rows of the rule set: what each rule's names mean.

All values here are fixed: they are the names of a public library's interface and
the vocabulary of the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULESET_VERSION, PARSER_VERSION, PQC_VERSION = "0.3.0", "python-ast-1", "0.2.0"
LIBRARY = "cryptography"
ROOT = "cryptography.hazmat.primitives."

RSA, ED25519, X25519 = "PY-CRYPTO-RSA", "PY-CRYPTO-ED25519", "PY-CRYPTO-X25519"
ECDSA, ECDH, AES, HASH = "PY-CRYPTO-ECDSA", "PY-CRYPTO-ECDH", "PY-CRYPTO-AES", "PY-CRYPTO-HASH"

#: rule, algorithm, primitive
RULES = [
    (RSA, "RSA", "RSA"), (ED25519, "Ed25519", "Ed25519"), (X25519, "X25519", "X25519"), (ECDSA, "ECDSA", "ECDSA"),
    (ECDH, "ECDH", "ECDH"), (AES, "AES", "AES"), (HASH, None, "HASH"),
]

#: rule, module, class, kind
CLASSES = [
    (RSA, "asymmetric.rsa", "RSAPrivateKey", "PRIVATE"), (RSA, "asymmetric.rsa", "RSAPrivateKeyWithSerialization", "PRIVATE"),
    (RSA, "asymmetric.rsa", "RSAPublicKey", "PUBLIC"), (RSA, "asymmetric.rsa", "RSAPublicKeyWithSerialization", "PUBLIC"),
    (ED25519, "asymmetric.ed25519", "Ed25519PrivateKey", "PRIVATE"), (ED25519, "asymmetric.ed25519", "Ed25519PublicKey", "PUBLIC"),
    (X25519, "asymmetric.x25519", "X25519PrivateKey", "PRIVATE"), (X25519, "asymmetric.x25519", "X25519PublicKey", "PUBLIC"),
]
#: rule, module, member that makes a key, kind
CONSTRUCTORS = [
    (RSA, "asymmetric.rsa", "generate_private_key", "PRIVATE"),
    (ED25519, "asymmetric.ed25519", "Ed25519PrivateKey.generate", "PRIVATE"), (ED25519, "asymmetric.ed25519", "Ed25519PrivateKey.from_private_bytes", "PRIVATE"),
    (ED25519, "asymmetric.ed25519", "Ed25519PublicKey.from_public_bytes", "PUBLIC"),
    (X25519, "asymmetric.x25519", "X25519PrivateKey.generate", "PRIVATE"), (X25519, "asymmetric.x25519", "X25519PrivateKey.from_private_bytes", "PRIVATE"),
    (X25519, "asymmetric.x25519", "X25519PublicKey.from_public_bytes", "PUBLIC"),
]
#: rule, module, member that generates a key, how a reader writes it
GENERATORS = [
    (RSA, "asymmetric.rsa", "generate_private_key", "rsa.generate_private_key"),
    (ED25519, "asymmetric.ed25519", "Ed25519PrivateKey.generate", "Ed25519PrivateKey.generate"),
    (X25519, "asymmetric.x25519", "X25519PrivateKey.generate", "X25519PrivateKey.generate"),
]
#: rule, method, operation, the kind of key it takes, the class a receiver is shown as
METHODS = [
    (RSA, "sign", "SIGN", "PRIVATE", "RSAPrivateKey"), (RSA, "decrypt", "DECRYPT", "PRIVATE", "RSAPrivateKey"),
    (RSA, "verify", "VERIFY", "PUBLIC", "RSAPublicKey"), (RSA, "encrypt", "ENCRYPT", "PUBLIC", "RSAPublicKey"),
    (ED25519, "sign", "SIGN", "PRIVATE", "Ed25519PrivateKey"), (ED25519, "verify", "VERIFY", "PUBLIC", "Ed25519PublicKey"),
    (X25519, "exchange", "KEY_ESTABLISHMENT", "PRIVATE", "X25519PrivateKey"),
]
#: method of a key that gives another: method, from, to
DERIVATIONS = [("public_key", "PRIVATE", "PUBLIC")]
#: rule, algorithm, marker, method, operation
MARKERS = [
    (ECDSA, "ECDSA", "asymmetric.ec.ECDSA", "sign", "SIGN"), (ECDSA, "ECDSA", "asymmetric.ec.ECDSA", "verify", "VERIFY"),
    (ECDH, "ECDH", "asymmetric.ec.ECDH", "exchange", "KEY_ESTABLISHMENT"),
]
AES_BLOCK = ["AES", "AES128", "AES256"]
AES_AEAD = ["AESGCM", "AESGCMSIV", "AESCCM", "AESSIV", "AESOCB3"]
#: kind of context, method, operation, how a reader writes it
AES_METHODS = [
    ("CIPHER", "encryptor", "ENCRYPT", "Cipher.encryptor"), ("CIPHER", "decryptor", "DECRYPT", "Cipher.decryptor"),
    ("AEAD", "encrypt", "ENCRYPT", "AESAEAD.encrypt"), ("AEAD", "decrypt", "DECRYPT", "AESAEAD.decrypt"),
]
HASHES = {
    "MD5": "MD5", "SHA1": "SHA-1", "SHA224": "SHA-224", "SHA256": "SHA-256", "SHA384": "SHA-384", "SHA512": "SHA-512",
    "SHA512_224": "SHA-512/224", "SHA512_256": "SHA-512/256", "SHA3_224": "SHA3-224", "SHA3_256": "SHA3-256", "SHA3_384": "SHA3-384",
    "SHA3_512": "SHA3-512", "SHAKE128": "SHAKE128", "SHAKE256": "SHAKE256", "BLAKE2b": "BLAKE2b", "BLAKE2s": "BLAKE2s", "SM3": "SM3",
}

# Vocabularies of persisted columns.
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
ROLES = ["DIGITAL_SIGNATURE", "KEY_ESTABLISHMENT", "SYMMETRIC_ENCRYPTION", "HASH", "PROTOCOL", "UNKNOWN"]
FINDING_STATUSES = ["ACTIVE", "RESOLVED", "SUPPRESSED"]
REVIEW_STATUSES = ["OPEN", "IN_REVIEW", "REVIEWED"]
JOB_STATUSES = ["QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
JOB_MOVES = [
    ("QUEUED", "RUNNING"), ("QUEUED", "CANCELLED"), ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("RUNNING", "QUEUED"), ("RUNNING", "CANCELLED"),
]
REVIEW_MOVES = [("OPEN", "IN_REVIEW"), ("IN_REVIEW", "REVIEWED"), ("IN_REVIEW", "OPEN"), ("REVIEWED", "IN_REVIEW")]


def direct_rows() -> list[tuple]:
    """(qualified, rule, algorithm, api, operation, basis): calls that name their evidence in full."""
    rows = [(ROOT + m + "." + c, rule, a, api, "KEY_GENERATION", "DIRECT_MODULE_API") for rule, m, c, api in GENERATORS for r, a, _ in RULES if r == rule]
    for rule, module, cls, kind in CLASSES:
        algorithm = next(a for r, a, _ in RULES if r == rule)
        rows += [(f"{ROOT}{module}.{cls}.{m}", rule, algorithm, f"{cls}.{m}", op, "CLASS_IMPORT") for r, m, op, k, _ in METHODS if r == rule and k == kind]
    rows += [(f"{ROOT}ciphers.algorithms.{c}", AES, "AES", f"algorithms.{c}", "CONSTRUCTION", "DIRECT_MODULE_API") for c in AES_BLOCK]
    rows += [(f"{ROOT}ciphers.aead.{c}", AES, "AES", f"aead.{c}", "CONSTRUCTION", "DIRECT_MODULE_API") for c in AES_AEAD]
    rows += [(f"{ROOT}hashes.{c}", HASH, name, f"hashes.{c}", "HASH", "DIRECT_MODULE_API") for c, name in HASHES.items()]
    return rows


def rows_of(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A dimension table from the rows above; their number is fixed."""
    names = [c.strip() for c in columns.split(",")]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
