"""The documents' format as Spark types, for from_json and for tables of documents.

A type can't hold itself, so nodes are nested to a depth that the caller names; children below it stay JSON texts, which
`node_schema` reads again. Field names and kinds are those of the format; document.faults says which values may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOR = "struct<r:double,g:double,b:double,a:double>"
PAINT = f"struct<type:string,color:{COLOR},imageRef:string,scaleMode:string,gradientTransform:array<array<double>>,gradientStops:array<struct<position:double,color:{COLOR}>>,opacity:double,visible:boolean>"
STROKE = f"struct<paint:{PAINT},weight:double,align:string>"
EFFECT = f"struct<type:string,color:{COLOR},offset:struct<x:double,y:double>,radius:double,spread:double,visible:boolean>"
UNIT_VALUE = "struct<unit:string,value:double>"
TEXT_STYLE = f"struct<fontFamily:string,fontStyle:string,fontSize:double,lineHeight:{UNIT_VALUE},letterSpacing:{UNIT_VALUE},textAlign:string,textDecoration:string,textCase:string>"
GEOMETRY = "struct<x:double,y:double,width:double,height:double>"
LAYOUT = "struct<layoutMode:string,itemSpacing:double,counterAxisSpacing:double,paddingTop:double,paddingRight:double,paddingBottom:double,paddingLeft:double,primaryAxisAlignItems:string,counterAxisAlignItems:string,layoutWrap:string,primaryAxisSizingMode:string,counterAxisSizingMode:string,clipsContent:boolean>"
CHILD_LAYOUT = "struct<layoutPositioning:string,layoutGrow:double,layoutAlign:string>"
RUN = f"struct<start:int,end:int,textStyle:{TEXT_STYLE},fills:array<{PAINT}>>"
NAMED = "id:string,name:string,description:string"


def node_schema(depth: int = 1) -> str:
    """A node with this many levels of nodes, itself one; what the last level holds are JSON texts. Fields of all five kinds, null where a kind has none."""
    children = "string" if depth <= 1 else node_schema(depth - 1)
    return (
        f"struct<type:string,id:string,name:string,geometry:{GEOMETRY},childLayout:{CHILD_LAYOUT},opacity:double,visible:boolean,rotation:double,layout:{LAYOUT},fills:array<{PAINT}>,fillStyleId:string,"
        f"strokes:array<{STROKE}>,strokeStyleId:string,effects:array<{EFFECT}>,effectStyleId:string,cornerRadius:double,clipsContent:boolean,svgSource:string,characters:string,textStyle:{TEXT_STYLE},textStyleId:string,"
        f"runs:array<{RUN}>,imageRef:string,scaleMode:string,path:string,componentId:string,overrides:map<string,struct<characters:string>>,children:array<{children}>>"
    )


def document_schema(depth: int = 4) -> str:
    node = node_schema(depth)
    styles = f"struct<paints:array<struct<{NAMED},paints:array<{PAINT}>>>,texts:array<struct<{NAMED},style:{TEXT_STYLE}>>,effects:array<struct<{NAMED},effects:array<{EFFECT}>>>>"
    rest = "fonts:array<struct<family:string,style:string>>,images:array<struct<ref:string,source:string,mimeType:string>>,metadata:struct<source:string,generator:string,generatedAt:string>"
    return f"struct<version:int,name:string,root:{node},styles:{styles},components:array<struct<{NAMED},root:{node}>>,{rest}>"


def typed(json: Column, depth: int = 4) -> Column:
    """A document's text as a struct; null if it is no JSON."""
    return F.from_json(json, document_schema(depth))


def typed_documents(documents: DataFrame, depth: int = 4) -> DataFrame:
    """page_id, document: documents (page_id, json) as export() has them."""
    return documents.select("page_id", typed(F.col("json"), depth).alias("document"))
