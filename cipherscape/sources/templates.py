"""A corpus of source snippets with the observations that each must give.

The expectations are written by hand from the rules, never taken from the engine.
``corpus`` lays the snippets out as files, one for each row of a key table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rule suffix, line, algorithm, api, operation, confidence, basis, function, class
Expected = tuple[str, int, str, str, str, str, str, str | None, str | None]


@dataclass(frozen=True)
class Template:
    name: str
    source: str
    expected: tuple[Expected, ...] = ()
    #: imports, symbols and calls of the snippet; None where it doesn't parse
    shape: tuple[int, int, int] | None = (0, 0, 0)


P = "from cryptography.hazmat.primitives"
GEN = ("KEY_GENERATION", "HIGH", "DIRECT_MODULE_API")

TEMPLATES = (
    Template(
        "rsa_forms",
        f"import cryptography.hazmat.primitives.asymmetric.rsa\nimport cryptography.hazmat.primitives.asymmetric.rsa as r\n{P}.asymmetric import rsa\n"
        f"{P}.asymmetric.rsa import generate_private_key as gen\n"
        "a = cryptography.hazmat.primitives.asymmetric.rsa.generate_private_key(1, 2)\nb = r.generate_private_key(1, 2)\nc = rsa.generate_private_key(1, 2)\nd = gen(1, 2)\n",
        tuple(("RSA", n, "RSA", "rsa.generate_private_key", *GEN, None, None) for n in (5, 6, 7, 8)),
        (4, 8, 4),
    ),
    Template(
        "rsa_annotated",
        f"{P}.asymmetric import rsa\n{P}.asymmetric.rsa import RSAPrivateKey, RSAPublicKey as Pub\n\ndef f(k: RSAPrivateKey, p: Pub, m):\n    k.sign(m)\n    p.verify(m)\n    p.encrypt(m)\n    p.sign(m)\n    m.sign(m)\n\n"
        "def g(load):\n    k: rsa.RSAPrivateKey = load()\n    return k.decrypt(b'x')\n",
        (
            ("RSA", 5, "RSA", "RSAPrivateKey.sign", "SIGN", "HIGH", "CLASS_ANNOTATION", "f", None),
            ("RSA", 6, "RSA", "RSAPublicKey.verify", "VERIFY", "HIGH", "CLASS_ANNOTATION", "f", None),
            ("RSA", 7, "RSA", "RSAPublicKey.encrypt", "ENCRYPT", "HIGH", "CLASS_ANNOTATION", "f", None),
            ("RSA", 13, "RSA", "RSAPrivateKey.decrypt", "DECRYPT", "HIGH", "CLASS_ANNOTATION", "g", None),
        ),
        (3, 5, 7),
    ),
    Template(
        "rsa_constructed",
        f"{P}.asymmetric import rsa\n\ndef f(m):\n    k = rsa.generate_private_key(1, 2)\n    p = k.public_key()\n    s = k.sign(m)\n    p.verify(s, m)\n    k.verify(s, m)\n    q = k\n    return q.sign(m)\n",
        (
            ("RSA", 4, "RSA", "rsa.generate_private_key", *GEN, "f", None),
            ("RSA", 6, "RSA", "RSAPrivateKey.sign", "SIGN", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("RSA", 7, "RSA", "RSAPublicKey.verify", "VERIFY", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("RSA", 10, "RSA", "RSAPrivateKey.sign", "SIGN", "MEDIUM", "ESTABLISHED_ALIAS", "f", None),
        ),
        (1, 2, 6),
    ),
    Template(
        "rsa_alias_order",
        f"{P}.asymmetric.rsa import RSAPrivateKey\n\ndef alias(k: RSAPrivateKey, m):\n    a = k\n    a.sign(m)\n\ndef alias_then_unknown(k: RSAPrivateKey, load, m):\n    a = k\n    if m:\n        a = load()\n    a.sign(m)\n\n"
        "def unknown_then_alias(k: RSAPrivateKey, load, m):\n    a = load()\n    a = k\n    a.sign(m)\n\ndef two_hops(k: RSAPrivateKey, m):\n    b = k\n    c = b\n    c.sign(m)\n",
        (
            ("RSA", 5, "RSA", "RSAPrivateKey.sign", "SIGN", "MEDIUM", "ESTABLISHED_ALIAS", "alias", None),
            ("RSA", 16, "RSA", "RSAPrivateKey.sign", "SIGN", "MEDIUM", "ESTABLISHED_ALIAS", "unknown_then_alias", None),
        ),
        (1, 5, 6),
    ),
    Template(
        "rsa_erased",
        f"{P}.asymmetric import rsa\n\ndef f(load, m):\n    k = rsa.generate_private_key(1, 2)\n    if m:\n        k = load()\n    k.sign(m)\n\ndef g(m):\n    rsa.generate_private_key(1, 2).private_numbers()\n    make().sign(m)\n    self.key.sign(m)\n",
        (
            ("RSA", 4, "RSA", "rsa.generate_private_key", *GEN, "f", None),
            ("RSA", 10, "RSA", "rsa.generate_private_key", *GEN, "g", None),
        ),
        (1, 3, 8),
    ),
    Template(
        "rsa_scopes",
        f"{P}.asymmetric import rsa\nKEY = rsa.generate_private_key(1, 2)\n\ndef shadowed(KEY, m):\n    return KEY.sign(m)\n\ndef module_level(m):\n    return KEY.sign(m)\n\ndef outer(m):\n    k = rsa.generate_private_key(1, 2)\n    def inner():\n        return k.sign(m)\n    return inner\n\n"
        "class Holder:\n    own = rsa.generate_private_key(1, 2)\n    def method(self, m):\n        own.sign(m)\n        return KEY.decrypt(m)\n",
        (
            ("RSA", 2, "RSA", "rsa.generate_private_key", *GEN, None, None),
            ("RSA", 8, "RSA", "RSAPrivateKey.sign", "SIGN", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "module_level", None),
            ("RSA", 11, "RSA", "rsa.generate_private_key", *GEN, "outer", None),
            ("RSA", 13, "RSA", "RSAPrivateKey.sign", "SIGN", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "outer.inner", None),
            ("RSA", 17, "RSA", "rsa.generate_private_key", *GEN, None, "Holder"),
            ("RSA", 20, "RSA", "RSAPrivateKey.decrypt", "DECRYPT", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "Holder.method", "Holder"),
        ),
        (1, 9, 8),
    ),
    Template(
        "rsa_class_call",
        f"{P}.asymmetric.rsa import RSAPrivateKey, RSAPublicKey\n\nclass Signer:\n    def run(self, k, m):\n        RSAPrivateKey.sign(k, m)\n        RSAPublicKey.sign(k, m)\n        return RSAPublicKey.verify(k, m)\n",
        (
            ("RSA", 5, "RSA", "RSAPrivateKey.sign", "SIGN", "HIGH", "CLASS_IMPORT", "Signer.run", "Signer"),
            ("RSA", 7, "RSA", "RSAPublicKey.verify", "VERIFY", "HIGH", "CLASS_IMPORT", "Signer.run", "Signer"),
        ),
        (2, 4, 3),
    ),
    Template("names_only", '"""rsa.generate_private_key and hashes.SHA256 in a docstring."""\n# AES(key)\n\nclass RSAPrivateKey:\n    pass\n\ndef f(k: RSAPrivateKey, m):\n    k.sign(m)\n    sign(m)\n', (), (0, 2, 2)),
    Template(
        "ed25519",
        f"{P}.asymmetric.ed25519 import Ed25519PrivateKey, Ed25519PublicKey\n\ndef f(raw, m):\n    k = Ed25519PrivateKey.generate()\n    s = k.sign(m)\n    v = Ed25519PublicKey.from_public_bytes(raw)\n    v.verify(s, m)\n    w = Ed25519PrivateKey.from_private_bytes(raw)\n    w.sign(m)\n    w.verify(m)\n",
        (
            ("ED25519", 4, "Ed25519", "Ed25519PrivateKey.generate", *GEN, "f", None),
            ("ED25519", 5, "Ed25519", "Ed25519PrivateKey.sign", "SIGN", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("ED25519", 7, "Ed25519", "Ed25519PublicKey.verify", "VERIFY", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("ED25519", 9, "Ed25519", "Ed25519PrivateKey.sign", "SIGN", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
        ),
        (2, 3, 7),
    ),
    Template(
        "x25519",
        f"{P}.asymmetric import x25519\n\ndef f(peer, k: x25519.X25519PrivateKey, p: x25519.X25519PublicKey):\n    k.exchange(peer)\n    p.exchange(peer)\n    n = x25519.X25519PrivateKey.generate()\n    return n.exchange(peer)\n",
        (
            ("X25519", 4, "X25519", "X25519PrivateKey.exchange", "KEY_ESTABLISHMENT", "HIGH", "CLASS_ANNOTATION", "f", None),
            ("X25519", 6, "X25519", "X25519PrivateKey.generate", *GEN, "f", None),
            ("X25519", 7, "X25519", "X25519PrivateKey.exchange", "KEY_ESTABLISHMENT", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
        ),
        (1, 2, 4),
    ),
    Template(
        "ecdsa",
        f"{P} import hashes\n{P}.asymmetric import ec\n{P}.asymmetric import ec as curves\n\ndef f(k, m, s):\n    k.sign(m, ec.ECDSA(hashes.SHA256()))\n    get().verify(s, m, curves.ECDSA(hashes.SHA1()))\n    how = ec.ECDSA(hashes.SHA3_256())\n    k.sign(m, signature_algorithm=how)\n    other = ec.ECDSA(None)\n    other = pick()\n    k.sign(m, other)\n    k.sign(m)\n    sign(m, ec.ECDSA(None))\n",
        (
            ("ECDSA", 6, "ECDSA", "ECDSA.sign", "SIGN", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("HASH", 6, "SHA-256", "hashes.SHA256", "HASH", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("ECDSA", 7, "ECDSA", "ECDSA.verify", "VERIFY", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("HASH", 7, "SHA-1", "hashes.SHA1", "HASH", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("HASH", 8, "SHA3-256", "hashes.SHA3_256", "HASH", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("ECDSA", 9, "ECDSA", "ECDSA.sign", "SIGN", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
        ),
        (3, 4, 16),
    ),
    Template(
        "ecdh",
        f"def f(k, peer):\n    {P}.asymmetric import ec\n    k.exchange(ec.ECDH(), peer)\n    return k.exchange(peer)\n\ndef g(k, peer):\n    kind = ec.ECDH()\n    return k.exchange(kind, peer)\n",
        (
            ("ECDH", 3, "ECDH", "ECDH.exchange", "KEY_ESTABLISHMENT", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("ECDH", 8, "ECDH", "ECDH.exchange", "KEY_ESTABLISHMENT", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "g", None),
        ),
        (1, 3, 5),
    ),
    Template(
        "aes",
        f"{P}.ciphers import Cipher, algorithms, modes\n{P}.ciphers.aead import AESGCM\n\ndef f(key, n, m):\n    c = Cipher(algorithms.AES(key), modes.GCM(n))\n    e = c.encryptor()\n    d = c.decryptor()\n    g = AESGCM(key)\n    g.encrypt(n, m, None)\n    o = Cipher(algorithms.Camellia(key), modes.CBC(n))\n    o.encryptor()\n    h = Cipher(algorithm=algorithms.AES256(key), mode=None)\n    h.encryptor()\n    return e.update(m), d\n",
        (
            ("AES", 5, "AES", "algorithms.AES", "CONSTRUCTION", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("AES", 6, "AES", "Cipher.encryptor", "ENCRYPT", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("AES", 7, "AES", "Cipher.decryptor", "DECRYPT", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("AES", 8, "AES", "aead.AESGCM", "CONSTRUCTION", "HIGH", "DIRECT_MODULE_API", "f", None),
            ("AES", 9, "AES", "AESAEAD.encrypt", "ENCRYPT", "MEDIUM", "CONSTRUCTOR_ASSIGNMENT", "f", None),
            ("AES", 12, "AES", "algorithms.AES256", "CONSTRUCTION", "HIGH", "DIRECT_MODULE_API", "f", None),
        ),
        (4, 5, 15),
    ),
    Template(
        "hashes",
        f"{P} import hashes\n{P}.hashes import BLAKE2b as B, Hash\nx = [hashes.MD5(), hashes.SHA512_224(), B(64), hashes.SM3()]\nh = Hash(hashes.SHAKE128(16))\nsha = hashes.SHA9()\nhashlib.sha256()\n",
        (
            ("HASH", 3, "MD5", "hashes.MD5", "HASH", "HIGH", "DIRECT_MODULE_API", None, None),
            ("HASH", 3, "SHA-512/224", "hashes.SHA512_224", "HASH", "HIGH", "DIRECT_MODULE_API", None, None),
            ("HASH", 3, "BLAKE2b", "hashes.BLAKE2b", "HASH", "HIGH", "DIRECT_MODULE_API", None, None),
            ("HASH", 3, "SM3", "hashes.SM3", "HASH", "HIGH", "DIRECT_MODULE_API", None, None),
            ("HASH", 4, "SHAKE128", "hashes.SHAKE128", "HASH", "HIGH", "DIRECT_MODULE_API", None, None),
        ),
        (3, 6, 8),
    ),
    Template("repeated", f"{P} import hashes\n\ndef f():\n    hashes.SHA256()\n    hashes.SHA256()\n", tuple(("HASH", n, "SHA-256", "hashes.SHA256", "HASH", "HIGH", "DIRECT_MODULE_API", "f", None) for n in (4, 5)), (1, 2, 2)),
    Template("broken", "def f(:\n    pass\n", (), None),
    Template("plain", "VALUE: int = 1\n\nasync def f(x):\n    y = [i for i in x]\n    return len(y)\n", (), (0, 2, 1)),
)


def path_of(key: Column) -> Column:
    return F.concat(F.lit("pkg"), (key % 7).cast("string"), F.lit("/mod_"), key.cast("string"), F.lit(".py"))


def corpus(keys: DataFrame, key: str, snapshot: str = "s") -> DataFrame:
    """(snapshot_id, path, size, content): a file for each row, its snippet chosen by the key."""
    sources = F.array(*[F.lit(t.source) for t in TEMPLATES])
    source = F.get(sources, (F.col(key) % len(TEMPLATES)).cast("int"))
    content = F.encode(source, "utf-8")
    return keys.select(F.lit(snapshot).alias("snapshot_id"), path_of(F.col(key)).alias("path"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def expected_sql() -> str:
    """VALUES of (template, rule_id, line, algorithm, api, operation, confidence, evidence_basis, fn, cls)."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    rows = [
        f"({k}, 'PY-CRYPTO-{e[0]}', {', '.join(map(quote, e[1:]))})" for k, t in enumerate(TEMPLATES) for e in t.expected
    ]
    return "(VALUES " + ", ".join(rows) + ") AS e(template, rule_id, line, algorithm, api, operation, confidence, evidence_basis, fn, cls)"
