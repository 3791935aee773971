"""SQL expressions over URLs and their parts.

A URL is cut once into an array of five parts (scheme, netloc, path with parameters,
query, fragment); an absent part is the empty string. Every function takes SQL expressions and
returns one. Values used more than once are bound to a lambda variable, so an expression
stays small and each step runs once per row however often the optimizer copies it.
"""

from __future__ import annotations

DEFAULT_SCHEME = "https"

# RFC 3986 appendix B, with the scheme restricted to its own grammar.
GENERIC_SYNTAX = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
)
_CUT = "\u0001"
_PARTS = _CUT.join(f"${i}" for i in range(1, 6))

# Schemes whose last path segment may carry ";parameters". Fixed values.
SCHEMES_WITH_PARAMS = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
)

_UNRESERVED_CODES = "^(?:2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])"
_KEPT_IN_PATH = r"A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%"


def bind(name: str, value: str, result: str) -> str:
    """``result`` with ``name`` standing for a value that is evaluated once."""
    return f"get(transform(array({value}), {name} -> {result}), 0)"


def url_parts(url: str) -> str:
    """``array(scheme, netloc, path, query, fragment)``; control characters are dropped."""
    visible = rf"regexp_replace(regexp_replace({url}, r'^[\x00-\x20]+', ''), r'[\x01\t\r\n]', '')"
    return f"split(regexp_replace({visible}, r'{GENERIC_SYNTAX}', '{_PARTS}'), '{_CUT}')"


def join_url(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    """Put five parts together; an empty part loses its delimiter."""
    return f"""concat(
      if({scheme} <> '', concat({scheme}, ':'), ''),
      if({netloc} <> '', concat('//', {netloc}), ''),
      if({netloc} <> '' AND {path} <> '' AND NOT startswith({path}, '/'), '/', ''), {path},
      if({query} <> '', concat('?', {query}), ''),
      if({fragment} <> '', concat('#', {fragment}), ''))"""


def with_default_scheme(url: str, scheme: str = DEFAULT_SCHEME) -> str:
    """Trim, and prefix the scheme where there is none; ``host:port`` is not a scheme."""
    kept = r"^$|^(?:/(?!/)|[A-Za-z][A-Za-z0-9+.\-]*:(?!\d+(?:[/?#]|$)))"
    return bind(
        "bare",
        f"trim({url})",
        f"""CASE WHEN bare RLIKE r'{kept}' THEN bare
          WHEN startswith(bare, '//') THEN concat('{scheme}:', bare)
          ELSE concat('{scheme}://', bare) END""",
    )


def ascii_host(netloc: str) -> str:
    """Non-ASCII host names in their ASCII form; the JVM call runs on those rows only."""
    return rf"""if({netloc} RLIKE r'[^\x00-\x7F]',
      coalesce(try_reflect('java.net.IDN', 'toASCII', {netloc}), {netloc}), {netloc})"""


def normal_netloc(netloc: str, scheme: str) -> str:
    """Host in lower case without trailing dots, default port or an empty port."""
    host = rf"regexp_replace(lower(regexp_replace({netloc}, r'^.*@', '')), r'\.+(?=(?::\d*)?$)', '')"
    return f"""concat(regexp_extract({netloc}, r'^(.*@)', 1), CASE {scheme}
      WHEN 'http' THEN regexp_replace({host}, r':(?:0*80)?$', '')
      WHEN 'https' THEN regexp_replace({host}, r':(?:0*443)?$', '')
      ELSE regexp_replace({host}, r':$', '') END)"""


def normal_escapes(text: str) -> str:
    """Escapes in upper case, escaped unreserved characters decoded, stray ``%`` escaped."""
    code = "upper(substring(piece, 1, 2))"
    return f"""if(contains({text}, '%'), array_join(transform(split({text}, '%'), (piece, i) -> CASE
      WHEN i = 0 THEN piece
      WHEN NOT piece RLIKE '^[0-9A-Fa-f]{{2}}' THEN concat('%25', piece)
      WHEN {code} RLIKE '{_UNRESERVED_CODES}'
        THEN concat(char(int(conv({code}, 16, 10))), substring(piece, 3))
      ELSE concat('%', {code}, substring(piece, 3)) END), ''), {text})"""


def escape_path(path: str) -> str:
    """Percent-encode, as UTF-8, what may not stand in a URL as it is."""
    kept = _KEPT_IN_PATH
    return f"""if({path} RLIKE r"[^{kept}]", array_join(transform(
      regexp_extract_all({path}, r"[{kept}]+|[^{kept}]+", 0),
      run -> if(run RLIKE r"^[{kept}]", run, replace(url_encode(run), '+', '%20'))), ''), {path})"""


def without_dot_segments(path: str) -> str:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    closed = rf"regexp_replace(regexp_replace({path}, r'/(\.{{1,2}})$', '/$1/'), '^/', '')"
    return rf"""if({path} RLIKE r'^/' AND {path} RLIKE r'/\.{{1,2}}(?:/|$)',
      concat('/', array_join(aggregate(split({closed}, '/'), array()::array<string>,
        (kept, segment) -> CASE segment
          WHEN '.' THEN kept
          WHEN '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0))
          ELSE concat(kept, array(segment)) END), '/')), {path})"""


def without_default_port(netloc: str, scheme: str) -> str:
    return f"""CASE
      WHEN {scheme} = 'http' AND {netloc} RLIKE ':0*80$' THEN replace({netloc}, ':80', '')
      WHEN {scheme} = 'https' AND {netloc} RLIKE ':0*443$' THEN replace({netloc}, ':443', '')
      ELSE {netloc} END"""


def sorted_query(query: str) -> str:
    """Pairs sorted by (key, value) and re-encoded form style; ``a`` becomes ``a=``."""

    def decoded(raw: str) -> str:
        valid = f"regexp_replace({raw}, '%(?![0-9A-Fa-f]{{2}})', '%25')"
        return f"coalesce(try_url_decode({valid}), {raw})"

    def encoded(raw: str) -> str:
        return f"replace(replace(url_encode({raw}), '%7E', '~'), '*', '%2A')"

    key = decoded("get(split(item, '=', 2), 0)")
    value = decoded("coalesce(get(split(item, '=', 2), 1), '')")
    return f"""if({query} <> '', array_join(transform(
      array_sort(transform(array_remove(split({query}, '&'), ''),
        item -> struct({key} AS k, {value} AS v))),
      pair -> concat({encoded('pair.k')}, '=', {encoded('pair.v')})), '&'), {query})"""


def single_slashes(path: str) -> str:
    return f"regexp_replace({path}, '/{{2,}}', '/')"


def _has_params(scheme: str) -> str:
    return f"{scheme} IN ({', '.join(repr(s) for s in SCHEMES_WITH_PARAMS)})"


def path_params(path: str, scheme: str) -> str:
    """The ``;parameters`` of the last path segment."""
    return f"if({_has_params(scheme)}, regexp_extract({path}, ';([^/]*)$', 1), '')"


def path_without_params(path: str, scheme: str) -> str:
    return f"if({_has_params(scheme)}, regexp_replace({path}, ';[^/]*$', ''), {path})"


SCHEME, NETLOC, PATH, QUERY, FRAGMENT = (f"p[{i}]" for i in range(5))
_ORDER = (SCHEME, NETLOC, PATH, QUERY, FRAGMENT)
Step = dict[str, str]


def _chain(url: str, text: str, steps: list[Step], result: str) -> str:
    """Cut ``text``, replace parts step by step, and compute the result; NULL for a NULL URL.

    A step maps parts to expressions over the parts of the step before.
    """
    state = f"array({url_parts(text)})"
    for step in [{SCHEME: f"lower({SCHEME})"}, *steps]:
        parts = ", ".join(step.get(part, part) for part in _ORDER)
        state = f"transform({state}, p -> array({parts}))"
    return f"if({url} IS NOT NULL, get(transform({state}, p -> {result}), 0), NULL)"


_JOINED = join_url(*_ORDER)
_NORMAL: list[Step] = [
    {
        NETLOC: normal_netloc(NETLOC, SCHEME),
        PATH: normal_escapes(PATH),
        QUERY: normal_escapes(QUERY),
        FRAGMENT: normal_escapes(FRAGMENT),
    },
    {NETLOC: ascii_host(NETLOC), PATH: escape_path(PATH)},
    {PATH: without_dot_segments(PATH)},
    {PATH: f"if({PATH} = '' AND {NETLOC} <> '', '/', {PATH})"},
]
_DROP_PORT: Step = {NETLOC: without_default_port(NETLOC, SCHEME)}
_SORT_QUERY: Step = {QUERY: sorted_query(QUERY)}
_DROP_FRAGMENT: Step = {FRAGMENT: "''"}


def normalize_url(url: str) -> str:
    """RFC 3986 syntax-based normalisation; a missing scheme becomes https."""
    return _chain(url, with_default_scheme(url), _NORMAL, _JOINED)


def clean_url(url: str) -> str:
    """Normalise, drop the default port, sort the query, collapse slashes, drop the fragment."""
    tidy = _DROP_PORT | _SORT_QUERY | {PATH: single_slashes(PATH)} | _DROP_FRAGMENT
    return _chain(url, with_default_scheme(url), [*_NORMAL, tidy], _JOINED)


def remove_default_port(url: str) -> str:
    return _chain(url, url, [_DROP_PORT], _JOINED)


def sort_query(url: str) -> str:
    return _chain(url, url, [_SORT_QUERY], _JOINED)


def collapse_slashes(url: str) -> str:
    """Runs of slashes in the path become one; parameters are left alone."""
    params = path_params(PATH, SCHEME)
    path = single_slashes(path_without_params(PATH, SCHEME))
    collapsed = {PATH: f"concat({path}, if({params} <> '', concat(';', {params}), ''))"}
    return _chain(url, url, [collapsed], _JOINED)


def drop_fragment(url: str) -> str:
    return _chain(url, url, [_DROP_FRAGMENT], _JOINED)


def url_components(url: str) -> str:
    """Struct of scheme, netloc, path, params, query, fragment."""
    parts = f"""named_struct('scheme', {SCHEME}, 'netloc', {NETLOC},
      'path', {path_without_params(PATH, SCHEME)}, 'params', {path_params(PATH, SCHEME)},
      'query', {QUERY}, 'fragment', {FRAGMENT})"""
    return _chain(url, url, [], parts)


def url_key(url: str) -> str:
    """URL-safe base64 of the raw URL, padding kept, without line breaks."""
    return rf"translate(translate(base64(binary({url})), '\r\n', ''), '+/', '-_')"


def url_from_key(key: str) -> str:
    return f"string(unbase64(translate({key}, '-_', '+/')))"
