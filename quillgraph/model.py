"""The property graph's labels and edge types, with keys and ends."""

from __future__ import annotations

#: Label -> key property.
LABELS = {
    "Module": "gradlePath", "Package": "name", "JavaClass": "fqn", "Entity": "fqn", "Method": "id", "SailRule": "uuid", "ExternalLibrary": "coordinate", "NpmPackage": "name", "TsFile": "path", "KFile": "path", "Table": "name",
    "FeatureToggle": "name", "JspPage": "path", "DockerService": "name", "Team": "handle", "ApiEndpoint": "path", "ExpressionTest": "path", "ResourceBundle": "path", "CdtType": "name", "CiPipeline": "name", "FtlTemplate": "path", "GroovyTest": "path",
}

#: Frame -> (edge type, label of its sources, label of its targets). Types with several pairs of ends have a frame for each.
EDGES = {
    "IMPORTS": ("IMPORTS", "JavaClass", "JavaClass"), "EXTENDS": ("EXTENDS", "JavaClass", "JavaClass"), "IMPLEMENTS": ("IMPLEMENTS", "JavaClass", "JavaClass"), "SPRING_IMPORTS": ("SPRING_IMPORTS", "JavaClass", "JavaClass"),
    "CONTAINS_JavaClass": ("CONTAINS", "Package", "JavaClass"), "CONTAINS_Package": ("CONTAINS", "Package", "Package"), "CONTAINS_Module_Package": ("CONTAINS", "Module", "Package"), "CONTAINS_SailRule": ("CONTAINS", "Module", "SailRule"),
    "CONTAINS_TsFile": ("CONTAINS", "Module", "TsFile"), "CONTAINS_KFile": ("CONTAINS", "Module", "KFile"), "CONTAINS_ExpressionTest": ("CONTAINS", "Module", "ExpressionTest"), "CONTAINS_ResourceBundle": ("CONTAINS", "Module", "ResourceBundle"),
    "CONTAINS_FtlTemplate": ("CONTAINS", "Module", "FtlTemplate"), "CONTAINS_GroovyTest": ("CONTAINS", "Module", "GroovyTest"),
    "DECLARES": ("DECLARES", "JavaClass", "Method"), "OVERLOADS": ("OVERLOADS", "Method", "Method"), "OVERRIDES": ("OVERRIDES", "Method", "Method"), "DEPENDS_ON": ("DEPENDS_ON", "Module", "Module"), "CALLS": ("CALLS", "SailRule", "SailRule"),
    "CALLS_BUILTIN": ("CALLS_BUILTIN", "SailRule", "JavaClass"), "CALLS_REACTION": ("CALLS_REACTION", "SailRule", "JavaClass"), "INJECTS": ("INJECTS", "JavaClass", "JavaClass"), "PRODUCES": ("PRODUCES", "JavaClass", "JavaClass"),
    "DEPENDS_ON_LIB": ("DEPENDS_ON_LIB", "Module", "ExternalLibrary"), "USES_LIBRARY_Module": ("USES_LIBRARY", "Module", "ExternalLibrary"), "USES_LIBRARY_JavaClass": ("USES_LIBRARY", "JavaClass", "ExternalLibrary"), "LIB_DEPENDS_ON": ("LIB_DEPENDS_ON", "ExternalLibrary", "ExternalLibrary"),
    "NPM_DEPENDS_ON": ("NPM_DEPENDS_ON", "NpmPackage", "NpmPackage"), "USES_NPM": ("USES_NPM", "Module", "NpmPackage"), "TS_IMPORTS": ("TS_IMPORTS", "TsFile", "TsFile"), "RENDERS": ("RENDERS", "TsFile", "TsFile"), "CSS_IMPORTS": ("CSS_IMPORTS", "TsFile", "TsFile"),
    "LOADS": ("LOADS", "KFile", "KFile"), "FK_TO": ("FK_TO", "Table", "Table"), "MAPS_TO": ("MAPS_TO", "Entity", "Table"), "GATES_JavaClass": ("GATES", "FeatureToggle", "JavaClass"), "GATES_SailRule": ("GATES", "FeatureToggle", "SailRule"),
    "DEFINED_IN": ("DEFINED_IN", "FeatureToggle", "JavaClass"), "JSP_INCLUDES": ("JSP_INCLUDES", "JspPage", "JspPage"), "SERVICE_DEPENDS_ON": ("SERVICE_DEPENDS_ON", "DockerService", "DockerService"), "OWNS": ("OWNS", "Team", "Module"),
    "TESTS_RULE": ("TESTS_RULE", "ExpressionTest", "SailRule"), "TESTS_CLASS": ("TESTS_CLASS", "GroovyTest", "JavaClass"), "REFERENCES_CDT": ("REFERENCES_CDT", "SailRule", "CdtType"), "CI_TRIGGERED_BY": ("CI_TRIGGERED_BY", "CiPipeline", "Module"), "USES_TEMPLATE": ("USES_TEMPLATE", "JavaClass", "FtlTemplate"),
}
