"""Schemas of the relations that the engine passes around."""

from __future__ import annotations

POSITION = "struct<file_name:string,line_start:int,line_end:int,column_start:int,column_end:int>"
PACKAGE = (
    "source_path string, parser string, name string, version string, target_versions array<string>, `commit` string, ecosystem string, "
    f"package_manager string, dep_groups array<string>, is_direct boolean, block {POSITION}, name_loc {POSITION}, version_loc {POSITION}"
)
EDGE = "source_path string, parent_key string, child_key string"
ARTIFACT = "name string, version string, filename string, ecosystem string, depends_on struct<name:string,version:string,filename:string>"
ADVISORY = "purl string, advisory_id string, symbol_type string, symbol_value string, symbol_name string"
CALL_SITE = "path string, symbol_text string, line_start int, line_end int, column_start int, column_end int"
ERROR = "path string, parser string, message string"
FILE = "path string, content binary"

#: Ecosystems that have a package URL type.
PURL_TYPES = {
    "Maven": "maven",
    "Go": "golang",
    "Packagist": "composer",
    "PyPI": "pypi",
    "RubyGems": "gem",
    "NuGet": "nuget",
    "npm": "npm",
    "ConanCenter": "conan",
    "crates.io": "cargo",
    "Pub": "pub",
    "Hex": "hex",
    "CRAN": "cran",
}

#: Ecosystems known by name only.
OTHER_ECOSYSTEMS = ("OSS-Fuzz", "Linux", "Debian", "Alpine", "Android", "GitHub Actions", "Rocky Linux", "AlmaLinux", "Bitnami", "Photon OS", "Bioconductor", "SwiftURL")
KNOWN_ECOSYSTEMS = (*PURL_TYPES, *OTHER_ECOSYSTEMS)
