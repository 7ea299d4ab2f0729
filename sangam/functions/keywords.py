"""The bilingual vocabulary: Roman-Urdu words and their SQL words."""

from __future__ import annotations

# The language's keyword pairs.
WORDS = {
    "CHUNO": "SELECT", "DIKHAO": "SELECT", "SE": "FROM", "JAHAN": "WHERE", "DAALO": "INSERT", "DALO": "INSERT",
    "MEIN": "INTO", "MAAN": "VALUES", "BADLO": "UPDATE", "RAKHO_YEH": "SET", "NIKALO": "DELETE", "GIRAO": "DROP",
    "MITAO": "DROP", "BANAO": "CREATE", "DEKHO": "SHOW", "TABLED": "TABLES", "ISTEMAAL": "USE", "AUR": "AND",
    "YA": "OR", "SAMOOH": "GROUP", "DWARA": "BY", "GINO": "COUNT", "JODO": "SUM", "AUSAAT": "AVG",
    "SABSE_BADA": "MAX", "SABSE_CHOTA": "MIN", "SHURU": "BEGIN", "PUKKA": "COMMIT", "WAPAS": "ROLLBACK",
    "NISHAAN": "SAVEPOINT", "PADHO": "READ", "LIKHO": "WRITE", "TAYYAR": "PREPARE", "CHALAO": "EXECUTE",
    "HATAO_TAYYAR": "DEALLOCATE", "JAISE": "AS", "ISTEMAL": "USING", "MILAO": "JOIN", "BAAYA": "LEFT",
    "DAAYA": "RIGHT", "POORA": "FULL", "BAHAR": "OUTER", "KUDRATI": "NATURAL", "SAMJHAO": "EXPLAIN",
    "KRAM": "ORDER", "CHADHTE": "ASC", "UTARTE": "DESC", "SEEMA": "LIMIT", "PAAR": "OFFSET",
    "BADLO_TABLE": "ALTER", "JODO_COLUMN": "ADD", "STAMBH": "COLUMN", "NAAM_BADLO": "RENAME", "SUDHAR": "MODIFY",
    "NIYAM": "CONSTRAINT", "VIDESHI": "FOREIGN", "SANDARBH": "REFERENCES", "JHARNA": "CASCADE", "ROKO": "RESTRICT",
    "KHALI": "NULL", "NAHI": "NOT", "MOOL": "DEFAULT", "ANOKHA": "UNIQUE", "SURAKSHA": "BACKUP",
    "WAPAS_LAO": "RESTORE", "BHEJO": "EXPORT", "SANGRAH": "COLLECTION", "DASTAVEZ": "DOCUMENT", "KHOJO": "FIND",
    "DAL_YA_BADLO": "UPSERT", "IKATHA": "AGGREGATE", "MILA": "MATCH", "PRADARSHI": "PROJECT", "KHOLO": "UNWIND",
    "DEKHO_MILA": "LOOKUP", "KRAM_SE": "SORT", "ROOP": "FORMAT", "RAKHTE": "HAVING", "JISME": "HAVING",
    "ALAG": "DISTINCT", "MUKHTALIF": "DISTINCT", "JAISA": "LIKE", "ANDAR": "IN", "BEECH": "BETWEEN",
    "MAUJOOD": "EXISTS", "SACH": "TRUE", "HAAN": "TRUE", "JHOOTH": "FALSE", "NA": "FALSE", "MAAMLA": "CASE",
    "JAB": "WHEN", "PHIR": "THEN", "TAB": "THEN", "WARNA": "ELSE", "KHATAM": "END", "MADAD": "HELP",
    "NIKLO": "QUIT", "KHATAM_KARO": "EXIT", "HALAT": "STATUS", "STHITI": "STATUS",
}
#: Verbs of the document side; LAAO is IMPORT before TABLE.
DOCUMENT_WORDS = {"RAKHO": "RAKHO", "MANGWAO": "MANGWAO", "LAAO": "MANGWAO", "DHUNDO": "DHUNDO", "DHUNDHO": "DHUNDO", "HATAO": "HATAO"}
NOISE = {"KARO"}
#: Type names of DDL.
TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "FLOAT": "double", "DOUBLE": "double", "STRING": "string",
    "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "BOOL": "boolean", "BOOLEAN": "boolean", "BLOB": "binary",
    "AUTO": "bigint", "DECIMAL": "decimal(18,2)", "DATE": "date", "TIMESTAMP": "timestamp", "JSON": "string",
}
