"""Settings of a query. They are frozen: executors get them with the plan."""

from __future__ import annotations

from dataclasses import dataclass, field


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# HTML vocabulary and the rules of the tree builder.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW_TEXT = _set("script style textarea title xmp iframe noembed noframes noscript")
RAW_DECODED = _set("textarea title")
BLOCKS_CLOSE_P = _set("p div h1 h2 h3 h4 h5 h6 ul ol table form section article header footer nav aside main blockquote pre hr address figure")
P_STOPS = _set("div td th li body html section article form blockquote table ul ol")
CLOSES = {
    "li": _set("li"), "dt": _set("dt dd"), "dd": _set("dt dd"), "td": _set("td th"), "th": _set("td th"), "tr": _set("tr"),
    "option": _set("option"), "thead": _set("thead tbody tfoot"), "tbody": _set("thead tbody tfoot"), "tfoot": _set("thead tbody tfoot"),
}
TABLE_STOPS = _set("html body table")
STOPS = {
    "td": TABLE_STOPS, "th": TABLE_STOPS, "tr": TABLE_STOPS, "thead": TABLE_STOPS, "tbody": TABLE_STOPS, "tfoot": TABLE_STOPS,
    "li": _set("html body ul ol menu"), "dt": _set("html body dl"), "dd": _set("html body dl"),
    "option": _set("html body table ul ol menu dl select tbody thead tfoot tr div section article"),
}


@dataclass(frozen=True)
class Config:
    """Default tables of URL classification and discovery."""

    api_hints: frozenset[str] = _set(
        "/api/ /apis/ /graphql /gql /rest/ /rpc/ /trpc/ /bff/ /gateway/ /service/ /services/ /backend/ /ajax/ /xhr/ /endpoint/ /endpoints/ "
        "/v1/ /v2/ /v3/ /v4/ /v5/ /wp-json/ /_next/data/ /__data /.netlify/functions/ /_api/ /xapi/ /odata/ .json .geojson"
    )
    api_host_prefixes: frozenset[str] = _set("api. apis. graphql. gql. rest. data.")
    api_query_keys: frozenset[str] = _set("format=json output=json alt=json type=json")
    api_path_leaves: frozenset[str] = _set("query search data feed export load fetch")
    media_exts: frozenset[str] = _set(
        ".png .jpg .jpeg .gif .webp .avif .bmp .heic .heif .mp4 .webm .m4v .mov .mkv .mp3 .wav .ogg .m4a .aac .opus .flac .m3u8 .pdf"
    )
    asset_exts: frozenset[str] = _set(".css .js .mjs .cjs .map .woff .woff2 .ttf .eot .otf .ico .svg")
    state_globals: frozenset[str] = _set(
        "__NEXT_DATA__ __NUXT__ __INITIAL_STATE__ __PRELOADED_STATE__ __DATA__ __APOLLO_STATE__ __RELAY_STORE__ __REDUX_STATE__ __STORE__ "
        "pageData preloadState initialState bootstrap APP_STATE SERVER_DATA"
    )
    endpoint_attrs: frozenset[str] = _set("data-url data-href data-src data-api data-endpoint data-action data-feed data-source")
    source_attrs: frozenset[str] = _set("data-src data-original data-lazy data-lazy-src data-bg data-image data-thumb data-poster poster")
    skip_prefixes: frozenset[str] = _set("javascript: mailto: tel: data: # blob:")
    skip_hosts: frozenset[str] = _set(
        "schema.org www.schema.org w3.org www.w3.org purl.org ogp.me xmlns.com www.w3schools.com fonts.googleapis.com fonts.gstatic.com "
        "www.googletagmanager.com googletagmanager.com www.google-analytics.com ssl.google-analytics.com cdn.jsdelivr.net unpkg.com cdnjs.cloudflare.com"
    )
    classifiers: tuple = field(default=())
    max_blobs: int | None = 50
    max_span: int = 100_000
    min_blob_chars: int = 24
    min_assign_chars: int = 40
    json_scan_cap: int = 2_000_000
    json_depth: int = 6
    #: Names that are references without a semicolon, too: all those of the HTML standard, none, or these of them.
    legacy_entities: bool | frozenset[str] = True
    charset_bytes: int = 8192
    shell_links: int = 3
    shell_scripts: int = 5


DEFAULT = Config()
