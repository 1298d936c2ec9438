"""Log templates: a message's constant part, and the variables in it.

A token is a run of ``+ - . 0-9 A-Z \\ _ a-z``. It is a variable if it has a digit, or
follows ``=`` and has a letter, or could be a hexadecimal number of two or more digits. In
the template a variable is one placeholder by its kind: an integer, a float, or text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INT, FLOAT, TEXT, ESCAPE = "\x11", "\x13", "\x12", "\\"
_TOKEN = r"[+\-.0-9A-Z\\_a-z]+"
#: A variable: with a digit; after '=' with a letter; hexadecimal of two digits or more.
VARIABLE = (
    r"(?:(?<![+\-.0-9A-Z\\_a-z])"
    r"(?:(?=[+\-.A-Z\\_a-z]*[0-9])" + _TOKEN + r"|(?<==)(?=[+\-.\\_]*[A-Za-z])" + _TOKEN + r"|[0-9a-fA-F]{2,}(?![+\-.0-9A-Z\\_a-z])))"
)
_INT = r"^(?:0|-?[1-9][0-9]{0,17})$"
_FLOAT = r"^-?[0-9]{1,15}\.[0-9]{1,15}$"
_FIND = re.compile(VARIABLE)


def variables(message: Column) -> Column:
    """The variables of a message, in order."""
    return F.regexp_extract_all(message, F.lit(VARIABLE), F.lit(0))


def variable_kind(token: Column) -> Column:
    """int, float or text, as a variable is stored. A float's digits fit 16 places."""
    digits = F.length(F.regexp_replace(token, r"[-.]", ""))
    return F.when(token.rlike(_INT), "int").when(token.rlike(_FLOAT) & (digits <= 16), "float").otherwise("text")


def logtype(message: Column) -> Column:
    """The template: constant text with a placeholder for every variable; placeholders and the
    escape in the constant text are escaped. Built-in expressions alone."""
    # cut the message at its variables and lay escaped constants and placeholders together
    constants = F.split(message, VARIABLE, -1)
    escaped = F.transform(constants, lambda c: F.regexp_replace(c, "([\\x11\\x12\\x13\\\\])", "\\\\$1"))
    kinds = F.transform(variables(message), lambda v: F.when(variable_kind(v) == "int", F.lit(INT)).when(variable_kind(v) == "float", F.lit(FLOAT)).otherwise(F.lit(TEXT)))
    return F.concat(F.array_join(F.zip_with(F.slice(escaped, 1, F.size(kinds)), kinds, lambda c, k: F.concat(c, k)), ""), F.element_at(escaped, -1))


def encode_python(message: str) -> tuple[str, list[str]]:
    """Template and variables of one message."""
    out, found, end = [], [], 0
    escape = re.compile("[\x11\x12\x13\\\\]")
    for m in _FIND.finditer(message):
        out.append(escape.sub(lambda x: ESCAPE + x[0], message[end : m.start()]))
        token = m[0]
        if re.match(_INT, token):
            out.append(INT)
        elif re.match(_FLOAT, token) and len(token.replace("-", "").replace(".", "")) <= 16:
            out.append(FLOAT)
        else:
            out.append(TEXT)
        found.append(token)
        end = m.end()
    out.append(escape.sub(lambda x: ESCAPE + x[0], message[end:]))
    return "".join(out), found


def decode_python(template: str, found: list[str]) -> str:
    out, i, k = [], 0, 0
    while i < len(template):
        c = template[i]
        if c == ESCAPE and i + 1 < len(template):
            out.append(template[i + 1])
            i += 2
        else:
            if c in (INT, FLOAT, TEXT):
                out.append(found[k])
                k += 1
            else:
                out.append(c)
            i += 1
    return "".join(out)


def rebuild(template: Column, found: Column) -> Column:
    """The message of a template and its variables."""

    @F.pandas_udf("string")
    def decode(templates: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or v is None else decode_python(t, list(v)) for t, v in zip(templates, lists)])

    return decode(template, found)


def schema_variables(message: Column, schema: dict[str, str]) -> Column:
    """Named variables of a user schema: {name: regular expression} -> map of name to the
    matches in the message. A capture group, if there is one, is what counts."""
    entries = []
    for name, expression in schema.items():
        group = 1 if re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", expression)).groups else 0
        entries += [F.lit(name), F.regexp_extract_all(message, F.lit(expression), F.lit(group))]
    return F.create_map(*entries)


def parse_schema(text: str) -> tuple[str, dict[str, str]]:
    """(delimiters, {name: expression}) of a schema file: ``delimiters:..`` and ``name:expression``
    lines, ``//`` comments. Named groups ``(?<x>..)`` are kept as groups."""
    delimiters, out = "", {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip("\r\n")
        if not line.strip() or line.lstrip().startswith("//"):
            continue
        name, colon, rest = line.partition(":")
        if not colon or not rest:
            raise ValueError(f"line {number}: want name:expression")
        if name.strip() == "delimiters":
            delimiters += rest.encode().decode("unicode_escape")
        else:
            expression = re.sub(r"\(\?<(\w+)>", r"(?P<\1>", rest)
            re.compile(expression)
            out[name.strip()] = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", expression)
    return delimiters, out
