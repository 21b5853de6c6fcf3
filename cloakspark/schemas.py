"""The types of results."""

MATCH = "struct<category:string,value:string,start:int,end:int,confidence:double>"
MATCHES = f"array<{MATCH}>"
SPAN = "struct<start:int,end:int,category:string,confidence:double,detector:string,residual:boolean>"
SPANS = f"array<{SPAN}>"
APPLIED = "array<struct<start:int,end:int,category:string,confidence:double,detector:string,residual:boolean,out_start:int,out_end:int>>"
TRANSFORMED = f"struct<text:string,spans:{APPLIED},error:string>"
ANONYMIZED = f"struct<text:string,matches:{MATCHES},error:string>"
TOKENIZED = "struct<text:string,mapping:map<string,string>,tokens:array<struct<token:string,original:string,category:string,start:int,end:int>>,error:string>"
RESTORED = "struct<text:string,restored:int,unresolved:array<string>>"
SANITIZED = "struct<json:string,fields:array<struct<path:string,category:string,detector:string,count:int>>,replaced:int,flagged_keys:array<string>,skipped:array<string>,error:string>"
VAULT = "token string, category string, key_id string, sealed binary, check string, subjects array<string>, created_at long, expires_at long"
AUDIT = "chain_id string, seq long, ts string, operation string, actor string, source string, policy string, fields string, checksums string, attributes string, guarded int, prev string, hash string"
