"""Schemas of the fact tables and the fixed vocabularies."""

from __future__ import annotations

CALLSITE = "struct<callee:string,line:int,line_in_body:int,via_macro:boolean,macro_name:string,args:array<string>,is_indirect:boolean,was_indirect:boolean>"
SUMMARY = "function_id long, summary_json string, created_at timestamp, updated_at timestamp, model_used string"
#: Passes and their tables, in order of dependence.
PASS_TABLES = {
    "allocation": "allocation_summaries",
    "free": "free_summaries",
    "init": "init_summaries",
    "memsafe": "memsafe_summaries",
    "verify": "verification_summaries",
    "leak": "leak_summaries",
    "overflow": "integer_overflow_summaries",
}
#: Tables whose newer callee rows also make a verification stale.
VERIFY_UPSTREAM = ("allocation_summaries", "free_summaries", "init_summaries", "memsafe_summaries")

TABLES = {
    "functions": f"id long, name string, signature string, canonical_signature string, file_path string, line_start int, line_end int, source string, pp_source string, source_hash string, params array<string>, callsites array<{CALLSITE}>, attributes string, decl_header string, linkage string",
    **{t: SUMMARY for t in PASS_TABLES.values()},
    "call_edges": "caller_id long, callee_id long, is_indirect boolean, file_path string, line int, `column` int",
    "address_taken_functions": "id long, function_id long, signature string, target_type string",
    "address_flows": "id long, function_id long, flow_target string, file_path string, line_number int, context_snippet string",
    "indirect_callsites": "id long, caller_function_id long, file_path string, line_number int, callee_expr string, signature string, context_snippet string",
    "indirect_call_targets": "callsite_id long, target_function_id long, confidence string, llm_reasoning string",
    "address_flow_summaries": "function_id long, flow_destinations_json string, semantic_role string, likely_callers_json string, created_at timestamp, updated_at timestamp, model_used string",
    "build_configs": "project_path string, project_name string, build_system string, configuration_json string, script_path string, artifacts_dir string, compile_commands_path string, llm_backend string, llm_model string, build_attempts int, last_built_at timestamp",
    "container_summaries": "function_id long, container_arg int, store_args array<int>, load_return boolean, container_type string, confidence string, heuristic_score int, heuristic_signals array<string>, model_used string",
    "typedefs": "id long, name string, kind string, underlying_type string, canonical_type string, file_path string, line_number int, definition string, pp_definition string",
    "issue_reviews": "function_id long, issue_index int, issue_fingerprint string, status string, reason string, updated_at timestamp",
    "function_blocks": "id long, function_id long, kind string, label string, line_start int, line_end int, source string, summary_json string, suggested_name string, suggested_signature string",
    "stdlib_cache": "name string, allocation_json string, free_json string, init_json string, memsafe_json string, model_used string",
    "dep_headers": "header_path string, library_name string, dep_db_path string, resolved_by string",
}
#: Natural keys for merges.
KEYS = {
    "functions": ["name", "signature", "file_path"],
    **{t: ["function_id"] for t in PASS_TABLES.values()},
    "address_taken_functions": ["function_id", "target_type"],
    "address_flows": ["function_id", "flow_target", "file_path", "line_number"],
    "indirect_callsites": ["caller_function_id", "file_path", "line_number", "callee_expr"],
    "indirect_call_targets": ["callsite_id", "target_function_id"],
    "address_flow_summaries": ["function_id"],
    "build_configs": ["project_path"],
    "container_summaries": ["function_id"],
    "typedefs": ["name", "kind", "file_path"],
    "issue_reviews": ["function_id", "issue_fingerprint"],
    "function_blocks": ["id"],
    "stdlib_cache": ["name"],
    "dep_headers": ["header_path"],
}
#: Children that go with a function: table -> its column.
CHILDREN = {t: "function_id" for t in (*PASS_TABLES.values(), "address_taken_functions", "address_flows", "address_flow_summaries", "container_summaries", "issue_reviews", "function_blocks")} | {"indirect_callsites": "caller_function_id", "indirect_call_targets": "target_function_id"}

# Vocabularies that the heuristics match, as published with the tool they describe.
ALLOC_KEYWORDS = ("alloc", "calloc", "malloc", "memalign", "realloc", "strdup", "strndup", "zalloc")
KNOWN_ALLOC_CALLS = ("aligned_alloc", "calloc", "malloc", "mmap", "new", "posix_memalign", "realloc")
STDLIB_ALLOCATORS = ("_Znam", "_Znwm", "aligned_alloc", "calloc", "malloc", "realloc")
SIZE_PARAMS = ("bytes", "count", "len", "n", "num", "size")
DEALLOC_KEYWORDS = ("dealloc", "delete", "destroy", "dispose", "free", "release")
KNOWN_FREE_CALLS = ("_ZdaPv", "_ZdlPv", "free", "munmap")
STDLIB_DEALLOCATORS = ("_ZdaPv", "_ZdlPv", "free", "munmap")
CONTAINER_NOUNS = ("avl", "btree", "bucket", "cache", "deque", "dict", "dlist", "fifo", "hash", "heap", "lifo", "list", "lru", "map", "pool", "queue", "rbtree", "ring", "set", "skiplist", "slist", "stack", "table", "tree", "trie")
CONTAINER_VERBS = ("add", "append", "contains", "delete", "dequeue", "emplace", "enqueue", "erase", "fetch", "find", "get", "has", "insert", "lookup", "pop", "prepend", "push", "put", "remove", "retrieve", "search", "store")
CONTAINER_TYPES = ("array", "cache", "hash_table", "heap", "linked_list", "other", "pool", "queue", "set", "stack", "tree")
CONTAINER_SYNONYMS = {
    "linked_list": ("circular_doubly_linked_list", "circular_linked_list", "dlist", "doubly_linked_list", "list", "singly_linked_list", "skip_list", "skiplist", "slist"),
    "tree": ("avl", "avl_tree", "b_tree", "balanced_binary_search_tree", "binary_search_tree", "binary_tree", "btree", "radix_tree", "rb_tree", "rbt", "rbtree", "red_black_tree", "splay_tree", "treap", "trie"),
    "array": ("array_list", "circular_buffer", "dynamic_array", "ring_buffer", "sorted_array", "vector"),
    "heap": ("fibonacci_heap", "priority_queue"),
    "queue": ("deque", "fifo", "fifo_queue"),
    "stack": ("array_based_stack", "array_stack", "dynamic_array_stack"),
    "cache": ("lru", "lru_cache"),
    "pool": ("buffer_pool", "free_list", "freelist", "memory_pool", "obstack", "slab_allocator"),
}
TYPE_WORDS = ("...", "bool", "char", "const", "double", "enum", "float", "int", "int16_t", "int32_t", "int64_t", "int8_t", "long", "short", "signed", "size_t", "struct", "uint16_t", "uint32_t", "uint64_t", "uint8_t", "union", "unsigned", "void")
CALL_KEYWORDS = ("if", "while", "for", "switch", "return", "sizeof", "typeof", "alignof", "offsetof", "defined")
INTRINSICS = {"llvm.memcpy": "memcpy", "llvm.memmove": "memmove", "llvm.memset": "memset"}
EXIT_REASONS = {123: "loop_oob", 124: "obj_oob", 125: "stack_oob", 150: "ubi", 151: "uaf", 152: "oob", 153: "null_deref", 161: "oob_upcast", 171: "panic"}
INTERNAL_EXITS = (123, 124, 125)
#: Issue kinds of weakness numbers: by patch sites, and by sanitizer runs. The two differ on purpose.
CWE_KINDS_PATCH = {
    "buffer_overflow": (119, 120, 121, 122, 124, 125, 126, 127, 129, 131, 134, 190, 193, 201, 680, 787, 788, 843),
    "double_free": (415, 763),
    "use_after_free": (416, 824),
    "null_deref": (476,),
    "uninitialized_use": (457,),
}
CWE_KINDS_RUN = {
    "buffer_overflow": (119, 120, 121, 122, 124, 125, 126, 127, 129, 131, 134, 193, 201, 468, 787, 788, 843),
    "integer_overflow": (190, 680),
    "double_free": (415, 763),
    "use_after_free": (416, 824),
    "null_deref": (476,),
    "uninitialized_use": (457,),
}
SANITIZER_KINDS = {
    "buffer_overflow": ("calloc-overflow", "container-overflow", "dynamic-stack-buffer-overflow", "global-buffer-overflow", "heap-buffer-overflow", "stack-buffer-overflow", "stack-buffer-underflow"),
    "use_after_free": ("heap-use-after-free", "stack-use-after-return", "stack-use-after-scope", "use-after-poison"),
    "double_free": ("alloc-dealloc-mismatch", "bad-free", "double-free"),
    "integer_overflow": ("allocation-size-too-big",),
    "stack_overflow": ("stack-overflow",),
    "null_deref": ("null_deref",),
    "segv": ("segv",),
}
PROPERTY_KINDS = {
    "valid-free": ("double_free", "invalid_free", "use_after_free"),
    "valid-deref": ("buffer_overflow", "null_deref", "uninitialized_use", "use_after_free"),
    "valid-memtrack": ("memory_leak",),
    "valid-memsafety": ("buffer_overflow", "double_free", "invalid_free", "memory_leak", "null_deref", "uninitialized_use", "use_after_free"),
    "no-overflow": ("division_by_zero", "integer_overflow", "shift_ub"),
}
SKIPPED_FRAMES = ("__libc_start_call_main", "__libc_start_main", "__wrap_main", "_start", "calloc", "cgc_calloc", "cgc_free", "cgc_malloc", "cgc_malloc_size", "cgc_realloc", "free", "malloc", "realloc")
SKIPPED_FILES = ("asan_malloc.c", "cgc_main_wrapper.c")
REVIEW_STATUSES = ("pending", "confirmed", "false_positive", "wontfix")
# End of fixed values.
