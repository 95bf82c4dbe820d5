"""Explicit schemas of the nested documents; optional fields are nullable, nothing is inferred."""

OUTLINE = "struct<area:int,on_change:double,moving:double,at_edge:boolean,bbox:array<int>,mean:double>"
ITEM = f"struct<frame:bigint,robots:array<{OUTLINE}>,missed:boolean,extra:boolean,unlabelled:double,accepted:boolean,reasons:array<string>>"
OUTLINES = f"clip string, source string, lit array<int>, keep_every int, seconds int, items array<{ITEM}>"
POSE = "struct<area:int,on_change:double,at_edge:boolean,bbox:array<int>,centre:array<int>>"
TRACK = f"struct<stretch:array<int>,start:int,direction:string,names:array<string>,named_from:string,followed_to:int,touching:int,frames:array<struct<frame:int,robots:array<{POSE}>>>>"
TRACKS = f"clip string, every int, keep int, tracks array<{TRACK}>"
PLACED = "struct<source:string,`class`:string,bbox:array<int>,visible:double>"
COMPOSED = f"run string, seed int, start int, classes map<string,string>, items array<struct<image:string,kind:string,clip:string,plate:string,robots:array<{PLACED}>>>"
SPRITES = "file string, clip string, frame int, robot string, paint string, x0 int, y0 int, kind string"
NEW_SPRITES = "file string, robot string, seed int"
TRANSFORMS = "applied_transform array<array<double>>, ply_file_path string, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
PLACEMENT = "transform array<array<double>>, scale double"
MATRIX = "array<array<double>>"
